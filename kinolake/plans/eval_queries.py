"""Queries on evidence, retrieval, evaluation, task control and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.functions import ids, judging, vectors as vf
from kinolake.functions.tokens import token_count
from kinolake.operators import evaluation, evidence, tables, vectors
from kinolake.plans import record_queries
from kinolake.plans.base import table
from kinolake.sources import rejects
from kinolake.streaming import ingest


def _asked(spark, folder):
    """Every vector whose id is divisible by 100 is a query."""
    return table(spark, folder, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def topk_cosine(spark, folder):
    out = vectors.top_k(_asked(spark, folder), _vectors(spark, folder), 8, 0.2)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def topk_segments(spark, folder):
    out = vectors.top_k(_asked(spark, folder), _vectors(spark, folder), 8)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def topk_approximate(spark, folder):
    return vectors.approximate_top_k(_asked(spark, folder), _vectors(spark, folder), 8, dim=64)


def topk_chunks(spark, folder):
    """Hits joined with their payload; missing payloads are left out."""
    hits = vectors.top_k(_asked(spark, folder), _vectors(spark, folder), 20)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", token_count("text").alias("tokens"))
    return hits.join(docs, "id").select("query_id", "id", "rank", "source", "tokens")


def _pool(spark, folder):
    """Text, entity and segment evidence one after the other; text and entity evidence have all embeddings, under the same ids."""
    emb = table(spark, folder, "embeddings")
    text = evidence.text_evidence(emb.select(F.concat(F.lit("e"), "vec_id").alias("id"), vf.score(F.col("label") / 10.0, F.lit(None).cast("double")).alias("score"), F.concat(F.lit("label "), "label").alias("content"), F.col("vec_id").alias("ord")))
    entity = evidence.entity_evidence(emb.select(F.concat(F.lit("e"), "vec_id").alias("entity_name"), vf.score(F.lit(None).cast("double"), F.col("label") / 5.0).alias("score"), F.lit("entity").alias("description"), F.col("vec_id").alias("ord")))
    seg = tables.global_rank(table(spark, folder, "segments").select("segment_id", "content", "video_name", "segment_index", "start_s", "end_s").distinct(), ["segment_id", "start_s", "end_s", "content"], "ord")
    segment = evidence.segment_evidence(seg.select(F.col("segment_id").alias("id"), F.lit(0.75).alias("score"), "content", "video_name", "segment_index", "start_s", "end_s", (F.col("ord") + 1).alias("ord")))
    return evidence.union_in_order([text, entity, segment])


def evidence_union(spark, folder):
    out = evidence.dedup(_pool(spark, folder))
    return evidence.public(out).select("id", "type", "score", F.md5("snippet").alias("snippet_md5"), "source", "video_name", "segment_index", "time_range", "branch", "ord")


def evidence_pool(spark, folder):
    out = evidence.cap(evidence.dedup(_pool(spark, folder)), max_rounds=2)
    return out.select("id", "type", "score", "branch", "ord")


def evidence_refinement(spark, folder):
    pool = evidence.dedup(_pool(spark, folder))
    done = table(spark, folder, "segments").filter("segment_index % 2 = 0").select(F.col("segment_id").alias("id"), F.lit("refined").alias("content")).distinct()
    left = evidence.refinable(pool, done).select("id", F.lit("open").alias("state"))
    return left.unionByName(evidence.use_refined(pool, done).filter("snippet = 'refined'").select("id", F.lit("refined").alias("state")))


def citations(spark, folder):
    pool = evidence.dedup(_pool(spark, folder)).filter("type <> 'segment'")
    cited = table(spark, folder, "embeddings").select(F.concat(F.lit("e"), "vec_id").alias("id"))
    strange = table(spark, folder, "documents").select(F.concat(F.lit("e"), F.col("doc_id") + 100_000).alias("id"))
    return evidence.check_citations(cited.union(strange), pool)


def relevance_filter(spark, folder):
    """Labels of good quality per source; all of a source where none is good."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    good = table(spark, folder, "labels").groupBy("doc_id").agg((F.max("quality") >= 5).alias("keep"))
    return evidence.relevant_or_all(docs.join(good, "doc_id"), ["source"], "keep")


def last_messages(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return evidence.last_messages(events, ["user_id"], "event_id", 10)


def winrate(spark, folder):
    return evaluation.win_rates(table(spark, folder, "votes").dropDuplicates(["custom_id", "metric", "run", "winner", "judged_at", "explanation", "orientation", "collection_id"]), table(spark, folder, "questions")).withColumn("percentage_a", F.round("percentage_a", 6))


def order_pairs(spark, folder):
    """Requests in both orders for each question and a pair of methods."""
    questions = evaluation.explode_questions(table(spark, folder, "questions"))
    baseline = table(spark, folder, "methods").filter("is_baseline").select(F.col("method").alias("base"))
    others = table(spark, folder, "methods").filter("not is_baseline").select("method")
    pairs = tables.for_each(tables.for_each(questions, baseline), others)
    return evaluation.both_orders(pairs, "base", "method").select("custom_id", "orientation", "answer_1", "answer_2")


def _expected(spark, folder):
    return order_pairs(spark, folder)


def coverage_audit(spark, folder):
    return evaluation.coverage(_expected(spark, folder), table(spark, folder, "votes"))


def coverage_missing(spark, folder):
    """Requests that should have been judged and weren't."""
    return evaluation.missing_ids(_expected(spark, folder), table(spark, folder, "votes"))


def custom_ids(spark, folder):
    votes = table(spark, folder, "votes").select("custom_id").distinct()
    return votes.select("custom_id", ids.request_parts("custom_id").alias("p")).select("custom_id", "p.*")


def collection_counts(spark, folder):
    return evaluation.counts_by_collection(table(spark, folder, "votes"))


def score_means(spark, folder):
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id")
    out = evaluation.score_means(labels.withColumn("metric", F.lit("quality")), "lang", "source", "metric", "quality")
    return out.withColumn("mean", F.round("mean", 6))


def imputed_means(spark, folder):
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    out = evaluation.imputed_means(labels, ["source"], [F.col("quality"), F.col("toxic")])
    return out.withColumn("mean", F.round("mean", 6))


def mean_difference(spark, folder):
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id")
    means = evaluation.imputed_means(labels, ["lang", "source"], [F.col("quality")])
    out = evaluation.difference(means, ["lang"], "source", "lecture_asr", "documentary_asr")
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "difference")])


def answer_pairs(spark, folder):
    """Answers of every source and those of one to the same collection, missing ones counted."""
    docs = table(spark, folder, "documents").filter("collection_id IS NOT NULL AND source IS NOT NULL")
    answers = docs.groupBy("collection_id", F.col("source").alias("method")).agg(F.min("doc_id").alias("answer"))
    asked = table(spark, folder, "questions").select("collection_id", F.lit(0).alias("query"))
    out = evaluation.pair_answers(asked, answers.withColumn("query", F.lit(0)), "answer_md", keep_missing=True)
    return out.groupBy("method").agg(F.count("*").alias("n"), F.sum((F.col("answer").isNull() | F.col("baseline_answer").isNull()).cast("bigint")).alias("n_skipped"))


def judged_long(spark, folder):
    """Valid judge output, a row a criterion."""
    loaded = rejects.load_records(table(spark, folder, "raw_results")).filter("reason IS NULL").distinct().select("custom_id", "line_id", F.from_json("content", judging.WINNER_TYPE).alias("judged"))
    valid = loaded.filter(judging.valid_winners(F.col("judged"))).select("line_id", F.explode("judged").alias("metric", "v"))
    return valid.select("line_id", "metric", F.col("v.Winner").alias("winner"), F.md5("v.Explanation").alias("explanation_md5"))


def latest_votes(spark, folder):
    rows = table(spark, folder, "votes").select("custom_id", "run", "metric", "winner", "judged_at")
    keyed = rows.withColumn("key", F.concat_ws("|", "custom_id", F.col("run").cast("string"), "metric"))
    last = tables.last_by_key(keyed.select("key", "winner", "judged_at"), "key", ["judged_at", "winner"])
    return last.select("key", "winner")


def request_price(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", token_count("text").alias("tokens"))
    return evaluation.token_price(docs, "tokens")


def status_histogram(spark, folder):
    orders = table(spark, folder, "orders")
    bucket = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_totalprice") > 200000, "large").otherwise("open")
    out = evaluation.status_counts(orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint")), bucket, "cents")
    return out


def task_table(spark, folder):
    parts = table(spark, folder, "nation").select(F.col("n_nationkey").alias("part"), (F.col("n_nationkey") * 1000 + 500).alias("tokens"))
    tasks = evaluation.build_tasks(parts, 3)
    status = F.when((F.col("part") + F.col("run")) % 5 == 0, "active").when((F.col("part") + F.col("run")) % 5 == 1, "completed").otherwise("pending")
    tasks = tasks.withColumn("status", status).withColumn("submit_attempts", F.col("part") % 4)
    return evaluation.may_submit(tasks, 20, 260000, 3).select("key", "may_submit")


def poll_delays(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", judging.next_poll_delay((F.col("o_orderkey") % 97).cast("int"), 10, 120, F.col("o_orderstatus") == "F").alias("delay"))


def tumbling_counts(spark, folder):
    out = ingest.tumbling_counts(table(spark, folder, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(spark, folder):
    out = ingest.sessions(table(spark, folder, "events"), gap="6 hours")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def unanswered(spark, folder):
    questions = evaluation.explode_questions(table(spark, folder, "questions")).select("collection_id", "query")
    answers = table(spark, folder, "votes").select("collection_id", ids.request_parts("custom_id")["query"].alias("query"), F.coalesce("explanation", F.lit("")).alias("answer"))
    return ingest.unanswered(questions, answers, ["collection_id", "query"])


QUERIES = (
    topk_cosine, topk_segments, topk_approximate, topk_chunks, evidence_union, evidence_pool, evidence_refinement, citations, relevance_filter, last_messages, winrate,
    order_pairs, coverage_audit, coverage_missing, custom_ids, collection_counts, score_means, imputed_means, mean_difference, answer_pairs, judged_long, latest_votes,
    request_price, status_histogram, task_table, poll_delays, tumbling_counts, sessions, unanswered,
)

_TOPK = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT query_id, id, list_cosine_similarity(q.e, v.e) AS sim FROM q, v {0}),
    r AS (SELECT query_id, id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s)"""
_POOL = """t AS (SELECT 'e' || vec_id AS id, 'text' AS type, label / CAST(10 AS DOUBLE) AS score, 'label ' || label AS snippet, 'text_chunk' AS source, NULL AS video_name, NULL AS segment_index, NULL AS time_range, 0 AS branch, vec_id AS ord FROM embeddings
      UNION ALL SELECT 'e' || vec_id, 'entity', greatest(0.0, 1 - label / CAST(5 AS DOUBLE)), 'entity', 'entity', NULL, NULL, NULL, 1, vec_id FROM embeddings
      UNION ALL SELECT segment_id, 'segment', 0.75, coalesce(content, ''), 'video_segment', video_name, CAST(segment_index AS VARCHAR), start_s || '-' || end_s, 2, row_number() OVER (ORDER BY segment_id) FROM (SELECT DISTINCT * FROM segments)),
    d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY branch, ord) = 1)"""
_EXPECTED = """x AS (SELECT collection_id || '-' || description || '++query' || q.id || '++' || CASE WHEN o = 'ori' THEN b.method ELSE m.method END || '++' || CASE WHEN o = 'ori' THEN m.method ELSE b.method END || '++' || o AS custom_id,
      o AS orientation, CASE WHEN o = 'ori' THEN b.method ELSE m.method END AS answer_1, CASE WHEN o = 'ori' THEN m.method ELSE b.method END AS answer_2
      FROM (SELECT DISTINCT collection_id, description, unnest(questions) AS q FROM questions), (SELECT method FROM methods WHERE is_baseline) b, (SELECT method FROM methods WHERE NOT is_baseline) m, (VALUES ('ori'), ('rev')) v(o))"""

SQL = {
    "judged_long": f"""
        WITH {record_queries._LOADED}, g AS (SELECT DISTINCT line_id, c FROM r WHERE reason IS NULL),
        m AS (SELECT line_id, c, unnest(['Comprehensiveness', 'Empowerment', 'Trustworthiness', 'Depth', 'Density', 'Overall Winner']) AS metric FROM g)
        SELECT line_id, metric, json_extract_string(c, '$."' || metric || '".Winner') AS winner, md5(json_extract_string(c, '$."' || metric || '".Explanation')) AS explanation_md5 FROM m""",
    "topk_cosine": _TOPK.format("WHERE list_cosine_similarity(q.e, v.e) >= 0.2") + " SELECT * FROM r WHERE rank <= 8",
    "topk_segments": _TOPK.format("") + " SELECT * FROM r WHERE rank <= 8",
    "topk_chunks": _TOPK.format("") + r" SELECT query_id, id, rank, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS INTEGER) AS tokens FROM r JOIN documents ON doc_id = id WHERE rank <= 20",
    "evidence_union": f"WITH {_POOL} SELECT id, type, score, md5(substr(snippet, 1, 300)) AS snippet_md5, source, video_name, segment_index, time_range, branch, ord FROM d",
    "evidence_pool": f"WITH {_POOL} SELECT id, type, score, branch, ord FROM d ORDER BY branch, ord, id LIMIT 30",
    "evidence_refinement": f"WITH {_POOL}, r AS (SELECT DISTINCT segment_id AS id FROM segments WHERE segment_index % 2 = 0) SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN 'refined' ELSE 'open' END AS state FROM d WHERE type = 'segment'",
    "citations": f"WITH {_POOL} SELECT 'e' || vec_id AS id, ('e' || vec_id) IN (SELECT id FROM d WHERE type <> 'segment') AS valid FROM (SELECT vec_id FROM embeddings UNION ALL SELECT doc_id + 100000 FROM documents)",
    "relevance_filter": """
        WITH g AS (SELECT doc_id, max(quality) >= 5 AS keep FROM labels GROUP BY 1), j AS (SELECT d.doc_id, source, keep FROM documents d JOIN g ON g.doc_id = d.doc_id),
        k AS (SELECT *, max(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS a FROM j) SELECT doc_id, source, keep FROM k WHERE coalesce(keep, false) OR a = 0""",
    "last_messages": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
    "winrate": """
        WITH v AS (SELECT DISTINCT custom_id, metric, run, winner, judged_at, explanation, orientation, collection_id FROM votes),
        w AS (SELECT collection_id, metric, winner, split_part(custom_id, '++', 3) AS f, split_part(custom_id, '++', 4) AS s FROM v WHERE winner IN ('Answer 1', 'Answer 2')),
        t AS (SELECT q.type AS domain, metric, least(f, s) AS a, greatest(f, s) AS b, CASE WHEN winner = 'Answer 1' THEN f ELSE s END AS win FROM w JOIN (SELECT DISTINCT collection_id, type FROM questions) q USING (collection_id) WHERE f <> s)
        SELECT domain, metric, a, b, CAST(sum(CASE WHEN win = a THEN 1 ELSE 0 END) AS BIGINT) AS wins_a, count(*) AS total, round(sum(CASE WHEN win = a THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS percentage_a
        FROM t GROUP BY GROUPING SETS ((domain, metric, a, b), (metric, a, b))""",
    "order_pairs": f"WITH {_EXPECTED} SELECT custom_id, orientation, answer_1, answer_2 FROM x",
    "coverage_audit": f"WITH {_EXPECTED}, e AS (SELECT DISTINCT custom_id FROM x) SELECT count(*) AS n_expected, count(CASE WHEN custom_id IN (SELECT custom_id FROM votes) THEN 1 END) AS n_present, count(CASE WHEN custom_id NOT IN (SELECT custom_id FROM votes) THEN 1 END) AS n_missing FROM e",
    "coverage_missing": f"WITH {_EXPECTED} SELECT DISTINCT custom_id FROM x WHERE custom_id NOT IN (SELECT custom_id FROM votes WHERE custom_id IS NOT NULL)",
    "custom_ids": """
        SELECT DISTINCT custom_id, split_part(custom_id, '-', 1) AS collection, substr(split_part(custom_id, '++', 1), strpos(custom_id, '-') + 1) AS description, CAST(substr(split_part(custom_id, '++', 2), 6) AS INTEGER) AS query,
        split_part(custom_id, '++', 3) AS first, split_part(custom_id, '++', 4) AS second, split_part(custom_id, '++', 5) AS orientation FROM votes""",
    "collection_counts": """
        SELECT coalesce(nullif(regexp_extract(custom_id, '^([0-9]+)-', 1), ''), 'unknown') AS collection, metric, count(*) AS n, CAST(sum(CASE WHEN coalesce(winner IN ('Answer 1', 'Answer 2'), false) THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid FROM votes GROUP BY 1, 2""",
    "score_means": """
        WITH j AS (SELECT lang AS domain, source AS method, 'quality' AS metric, CAST(quality AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id))
        SELECT domain, method, metric, round(avg(v), 6) AS mean, count(v) AS n, CAST(grouping(domain) AS INTEGER) AS overall FROM j GROUP BY GROUPING SETS ((domain, method, metric), (method, metric))""",
    "imputed_means": "SELECT source, round(avg(coalesce(CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE), 3.0)), 6) AS mean, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "mean_difference": """
        WITH m AS (SELECT lang, source, avg(coalesce(CAST(quality AS DOUBLE), 3.0)) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
        p AS (SELECT lang, coalesce(max(CASE WHEN source = 'lecture_asr' THEN mean END), 0) AS a, coalesce(max(CASE WHEN source = 'documentary_asr' THEN mean END), 0) AS b FROM m GROUP BY 1)
        SELECT lang, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS difference FROM p""",
    "answer_pairs": """
        WITH a AS (SELECT collection_id, source AS method, min(doc_id) AS answer FROM documents WHERE collection_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT collection_id, method FROM questions, (SELECT DISTINCT method FROM a WHERE method <> 'answer_md')),
        j AS (SELECT g.method, a.answer, b.answer AS base FROM g LEFT JOIN a ON a.collection_id = g.collection_id AND a.method = g.method LEFT JOIN a b ON b.collection_id = g.collection_id AND b.method = 'answer_md')
        SELECT method, count(*) AS n, CAST(sum(CASE WHEN answer IS NULL OR base IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped FROM j GROUP BY 1""",
    "latest_votes": """
        SELECT concat_ws('|', custom_id, CAST(run AS VARCHAR), metric) AS key, winner FROM votes
        QUALIFY row_number() OVER (PARTITION BY concat_ws('|', custom_id, CAST(run AS VARCHAR), metric) ORDER BY judged_at DESC NULLS LAST, winner DESC NULLS LAST) = 1""",
    "request_price": r"""
        WITH t AS (SELECT coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS n FROM documents)
        SELECT count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS tokens, sum(n) / CAST(1000000 AS DOUBLE) * CAST(0.075 AS DOUBLE) * 5 AS price FROM t""",
    "status_histogram": """
        SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 200000 THEN 'large' ELSE 'open' END AS bucket, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS tokens FROM orders GROUP BY 1""",
    "task_table": """
        WITH t AS (SELECT r AS run, n_nationkey AS part, n_nationkey * 1000 + 500 AS tokens, CASE (n_nationkey + r) % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' ELSE 'pending' END AS status, n_nationkey % 4 AS tries FROM nation, range(1, 4) x(r)),
        a AS (SELECT count(*) AS n, coalesce(sum(tokens), 0) AS t FROM t WHERE status = 'active'),
        p AS (SELECT *, row_number() OVER (ORDER BY run, part) AS k, sum(tokens) OVER (ORDER BY run, part) AS s FROM t WHERE status = 'pending' AND tries < 3)
        SELECT p.run || ':' || p.part AS key, a.n + p.k <= 20 AND a.t + p.s <= 260000 AS may_submit FROM p, a""",
    "poll_delays": "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 10 ELSE least(120, greatest(10, (o_orderkey % 97) * 2)) END AS INTEGER) AS delay FROM orders",
    "tumbling_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
        n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM n GROUP BY user_id, k""",
    "unanswered": """
        WITH q AS (SELECT DISTINCT collection_id, unnest(questions).id AS query FROM questions), a AS (SELECT DISTINCT collection_id, CAST(substr(split_part(custom_id, '++', 2), 6) AS INTEGER) AS query FROM votes WHERE trim(coalesce(explanation, '')) <> '')
        SELECT q.collection_id, q.query FROM q ANTI JOIN a ON a.collection_id = q.collection_id AND a.query = q.query""",
}
