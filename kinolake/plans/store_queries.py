"""Queries that go through stored tables, files and streams, and lookups on the graph, with their SQL.

Stored tables are written below the shared checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinolake.functions import ids, judging, text
from kinolake.functions import vectors as vf
from kinolake.operators import evaluation, evidence, graph, resolve, segments, tables, vectors
from kinolake.plans import content_queries, graph_queries
from kinolake.plans.base import table
from kinolake.session import ensure_checkpoint_dir
from kinolake.sources import files
from kinolake.streaming import ingest


def _store(spark) -> tables.Store:
    return tables.Store(spark, f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}")


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "lang")


# ---- stored tables and files


def store_round_trip(spark, folder):
    store = _store(spark)
    store.commit("documents", _docs(spark, folder))
    return store.read("documents")


def store_append(spark, folder):
    store = _store(spark)
    store.append("documents", _docs(spark, folder))
    store.append("documents", table(spark, folder, "labels").select(F.col("doc_id"), F.lit("label").alias("source"), F.lit(None).cast("string").alias("lang")))
    return store.read("documents")


def store_upsert(spark, folder):
    """Every second embedding is put in again under its id with its label as the only value, others under new ids."""
    store = _store(spark)
    emb = table(spark, folder, "embeddings")
    store.commit("vectors", emb.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value")))
    store.upsert("vectors", emb.select((F.col("vec_id") * 2).alias("id"), F.col("vec_id").cast("double").alias("value")))
    return store.read("vectors")


def store_dropped(spark, folder):
    store = _store(spark)
    store.commit("documents", _docs(spark, folder))
    store.drop("documents")
    return store.read("documents").agg(F.count("*").alias("n"))


def graph_round_trip(spark, folder):
    store = _store(spark)
    files.write_graph(store, graph_queries.brand_nodes(spark, folder), graph_queries.edges(spark, folder), "_tm")
    nodes, found = files.read_graph(store, "_tm")
    return found.select("src", "tgt", "weight", "ord").unionByName(nodes.select(F.col("entity_name").alias("src"), F.col("entity_type").alias("tgt"), F.size("source_ids").cast("double").alias("weight"), F.lit(0).alias("ord")))


def jsonl_round_trip(spark, folder):
    where = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    files.write_jsonl(_docs(spark, folder), where)
    return files.read_jsonl(spark, where, "doc_id bigint, source string, lang string", "doc_id")[0]


def dead_letters(spark, folder):
    store = _store(spark)
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    files.keep_dead_letters(store, labels.filter("toxic IS NULL"), "no label")
    files.keep_dead_letters(store, labels.filter("toxic NOT IN (0, 1)"), "not a label")
    return store.read("dead_letter").select("reason", F.get_json_object("row", "$.doc_id").cast("bigint").alias("doc_id"))


def answers_appended(spark, folder):
    """Answers of one source, then of all others, of which only those to collections without one are kept."""
    store = _store(spark)
    docs = table(spark, folder, "documents").filter("collection_id IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    best = lambda df: df.groupBy("collection_id").agg(F.max(F.md5("text")).alias("answer"))
    first = F.coalesce(F.col("source") == "answer_md", F.lit(False))
    files.append_answers(store, "answers", best(docs.filter(first)), ["collection_id"])
    files.append_answers(store, "answers", best(docs.filter(~first)), ["collection_id"])
    return store.read("answers")


def streamed_documents(spark, folder):
    """Documents from a stream into a stored table, each id once with its greatest row."""
    store = _store(spark)
    schema = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").schema
    stream = ingest.stream_parquet(spark, f"{folder}/documents*.parquet", schema)
    ingest.incremental_ingest(stream, store, "documents", "doc_id", f"{store.folder}/progress").awaitTermination()
    return store.read("documents")


# ---- keyed tables


def key_list(spark, folder):
    return tables.all_keys(_docs(spark, folder), "doc_id")


def point_lookup(spark, folder):
    return tables.get_by_id(_docs(spark, folder), 7, "doc_id")


def newest_rows(spark, folder):
    return tables.newest(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "o_orderkey")


def safe_names(spark, folder):
    return table(spark, folder, "videos").distinct().select("path", text.path_safe("path").alias("name"))


def tasks_done(spark, folder):
    """Tasks of run 2 with their state."""
    parts = table(spark, folder, "nation").select(F.col("n_nationkey").alias("part"))
    tasks = evaluation.build_tasks(parts, 3)
    state = F.when(F.col("part") % 4 == 0, "completed").when(F.col("part") % 4 == 1, "expired").when(F.col("part") % 4 == 2, F.lit(None)).otherwise("active")
    return evaluation.select_tasks(tasks.withColumn("status", state), run=2).select("key", evaluation.is_done().alias("done"))


# ---- segments and chunks


def chunk_segments(spark, folder):
    return graph.chunk_segments(table(spark, folder, "chunks").select("chunk_id").distinct(), table(spark, folder, "chunks"))


def chunk_time_ranges(spark, folder):
    """Segments of all chunks with their times, null where the segment is missing."""
    found = chunk_segments(spark, folder)
    rows = table(spark, folder, "segments").select("segment_id", "video_name", "start_s", "end_s").distinct()
    return found.join(rows, "segment_id", "left").select("segment_id", "video_name", text.clock("start_s").alias("start"), text.clock("end_s").alias("end"))


def segments_in_order(spark, folder):
    rows = table(spark, folder, "segments").select("segment_id", "video_name", "segment_index").distinct()
    return segments.in_order(rows).select("segment_id", "place")


def evidence_listing(spark, folder):
    """The first fifty segments as lines."""
    rows = table(spark, folder, "segments").select("segment_id", "video_name", "segment_index", "start_s", "end_s", "caption").distinct()
    found = evidence.segment_evidence(rows.select(F.col("segment_id").alias("id"), (F.col("segment_index") / 7.0).alias("score"), "video_name", "segment_index", "start_s", "end_s", F.md5(F.coalesce("caption", F.lit(""))).alias("content")))
    return evidence.listing(found, ("id", "snippet", "time_range"))


def evidence_marked(spark, folder):
    emb = table(spark, folder, "embeddings")
    found = evidence.text_evidence(emb.select(F.col("vec_id").alias("id"), F.lit(0.5).alias("score"), F.lit("x").alias("content")))
    return evidence.mark_cited(found, emb.filter("label < 4").select(F.col("vec_id").cast("string").alias("id"))).select("id", "validated")


def text_composed(spark, folder):
    """Without control characters, in composed form; the same inside a struct."""
    docs = table(spark, folder, "documents").select("doc_id", F.struct("text", F.array("source").alias("sources")).alias("s"))
    clean = text.clean_nested(F.col("s"), docs.schema["s"].dataType)
    return docs.select("doc_id", clean.alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), F.get("c.sources", F.lit(0)).alias("source"))


def prompts(spark, folder):
    """A template filled at once, a joined context, and a chat history."""
    rows = table(spark, folder, "part")
    filled = text.fill_template("Name: {name}, type: {type}; {name}!", name=F.col("p_name"), type=F.col("p_type"))
    chat = text.chat_messages(F.array("p_name", "p_brand", "p_type"))
    return rows.select("p_partkey", filled.alias("prompt"), F.concat_ws("-----New Chunk-----\n", "p_name", "p_type").alias("context"), F.array_join(F.transform(chat, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("chat"), text.csv_text(F.array("p_name", "p_brand")).alias("lines"))


def yes_answers(spark, folder):
    parts = table(spark, folder, "part")
    answer = F.when(F.col("p_size") % 4 == 0, ' "Yes" ').when(F.col("p_size") % 4 == 1, "YES\n").when(F.col("p_size") % 4 == 2, "yes, go on").otherwise("'no'")
    return parts.select("p_partkey", text.yes(answer).alias("yes"))


def cosine_pairs(spark, folder):
    """Every embedding with the next one."""
    a = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(vf.cosine(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(vf.legacy_score(F.col("vec_id") / 1000.0), 6).alias("legacy"))


def cache_keys(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return events.select("event_id", ids.cache_key(F.lit("m"), F.col("event_type")).alias("key"))


# ---- judging


def _judged(spark, folder):
    """Judge output made from labels: scores, and winners of different validity."""
    labels = table(spark, folder, "labels").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    one = lambda names, field, value: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{m}":{{"{field}":'), value, F.lit(',"Explanation":"e"}')) for m in names]), F.lit("}"))
    score = one(judging.SCORE_METRICS, "Score", F.coalesce(F.col("q"), F.lit(9)).cast("string"))
    return labels.select("doc_id", "q", score.alias("scores"), one(judging.WINNER_METRICS, "Winner", F.concat(F.lit('"Answer '), F.coalesce(F.col("q"), F.lit(9)).cast("string"), F.lit('"'))).alias("winners"))


def judge_valid(spark, folder):
    rows = _judged(spark, folder)
    return rows.select("doc_id", judging.valid_scores(F.from_json("scores", judging.SCORE_TYPE)).alias("score_valid"), judging.valid_winners(F.from_json("winners", judging.WINNER_TYPE)).alias("winner_valid"))


def results_parsed(spark, folder):
    """Good results, those to ask again and those given up; requests are the even ids."""
    rows = _judged(spark, folder)
    answers = rows.select(F.col("doc_id").cast("string").alias("custom_id"), F.concat(F.lit("Here: "), "winners", F.lit(" end")).alias("answer"), (F.col("doc_id") % 8).cast("int").alias("tries"))
    asked = rows.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("custom_id"))
    good, again, lost = evaluation.parse_results(answers, asked, judging.valid_winners(F.col("judged")), judging.WINNER_TYPE)
    state = lambda df, name: df.select("custom_id", F.lit(name).alias("state"))
    return state(good, "good").unionByName(state(again, "again")).unionByName(state(lost, "lost"))


def query_count(spark, folder):
    return evaluation.query_count(table(spark, folder, "votes").filter("custom_id IS NOT NULL"))


# ---- graph


def extraction_records(spark, folder):
    """Entities and relations parsed from records."""
    answers = content_queries._record(spark, folder).select(F.col("p_partkey").cast("string").alias("chunk_id"), "answer")
    entities, relations = graph.parse_records(answers)
    out = entities.select("source_id", "seq", F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), "description", F.lit(None).cast("double").alias("weight"))
    return out.unionByName(relations.select("source_id", "seq", F.col("src_id").alias("a"), F.col("tgt_id").alias("b"), "description", "weight"))


def extraction_counts(spark, folder):
    answers = content_queries._record(spark, folder).select(F.col("p_partkey").cast("string").alias("chunk_id"), "answer")
    entities, relations = graph.parse_records(answers)
    return entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("kind"), "n").unionByName(relations.agg(F.count("*").alias("n")).select(F.lit("relations").alias("kind"), "n"))


def merged_with_existing(spark, folder):
    """Edges of the even order lines merged into those of the odd ones."""
    rel = graph_queries.relations(spark, folder)
    old = graph.merge_edges(rel.filter("ord % 2 = 1"))
    return graph.merge_edges(rel.filter("ord % 2 = 0"), old).select("src", "tgt", "weight", "description", F.array_join("source_ids", ",").alias("source_ids"), "ord")


def nodes_found(spark, folder):
    asked = table(spark, folder, "part").select(F.concat(F.lit("S"), "p_partkey").alias("entity_name"))
    nodes = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"))
    return graph.has_nodes(asked, nodes)


def node_and_edge(spark, folder):
    """One node and one edge by name."""
    nodes = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"), "s_acctbal")
    one = graph.get_node(nodes, "S3").select(F.lit("node").alias("kind"), F.col("entity_name").alias("name"), F.col("s_acctbal").alias("value"))
    first = table(spark, folder, "lineitem").filter("l_suppkey = 1").agg(F.min(F.concat(F.lit("P"), "l_partkey")).alias("a")).first().a
    found = graph.get_edge(graph_queries.edges(spark, folder), "S1", first or "").select(F.lit("edge").alias("kind"), F.concat_ws("-", "src", "tgt").alias("name"), F.col("weight").alias("value"))
    return one.unionByName(found)


def attributes_merged(spark, folder):
    """Suppliers' attributes overwritten where a customer of the same number has a value; new numbers are added."""
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = table(spark, folder, "customer").select((F.col("c_custkey") * 3).alias("k"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return tables.merge_attributes(old, new, ["k"])


def clusters_attached(spark, folder):
    nodes = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"))
    out = graph.attach_clusters(nodes, graph_queries._members(spark, folder).filter("cluster <> 'N3'"))
    return out.select("entity_name", F.array_join(F.transform("clusters", lambda c: F.concat_ws(":", c["level"].cast("string"), c["cluster"])), ",").alias("clusters"))


def level_counts(spark, folder):
    return graph.level_counts(graph_queries._members(spark, folder))


def edges_in_order(spark, folder):
    one = graph.stable_order(graph_queries.relations(spark, folder).select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt")).distinct())
    return tables.global_rank(one, ["label"], "place").select("label", "place")


def entity_hits(spark, folder):
    """Hits with their nodes and degrees; hits without a node are left out, nodes without edges have degree 0."""
    hits = table(spark, folder, "part").select(F.concat(F.lit("S"), "p_partkey").alias("entity_name"), F.col("p_size").alias("rank"))
    nodes = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"), "s_name")
    degrees = graph.node_degree(graph_queries.edges(spark, folder).filter("tgt <> 'S2'"))
    return hits.join(nodes, "entity_name").join(degrees, "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def first_hits(spark, folder):
    """Of the hits of every name the one with the smallest rank."""
    hits = table(spark, folder, "part").select(F.col("p_brand").alias("entity_name"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("id"))
    return tables.first_by_key(hits, "entity_name", ["rank", "id"])


def resolved_mentions(spark, folder):
    """Mentions and edges under resolved names; self-loops go."""
    parts = table(spark, folder, "part").withColumn("run", F.lit("r")).withColumn("batch", (F.col("p_partkey") % 3).cast("int"))
    found = parts.filter("p_size % 2 = 0").groupBy("run", "batch", F.col("p_name").alias("raw_name")).agg(F.min("p_brand").alias("resolved_name"))
    named = resolve.apply_to_mentions(parts.select("run", "batch", F.col("p_name").alias("entity_name"), "p_partkey"), found)
    turned = resolve.apply_to_edges(parts.select("run", "batch", F.col("p_name").alias("src_id"), F.col("p_brand").alias("tgt_id"), "p_partkey"), found)
    return named.select("p_partkey", F.lit("mention").alias("kind"), F.col("entity_name").alias("name")).unionByName(turned.select("p_partkey", F.lit("edge").alias("kind"), F.concat_ws("-", "src_id", "tgt_id").alias("name")))


def vectors_embedded(spark, folder):
    """Texts through a provider (number of characters, number of words) into a table of vectors."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("text"))
    old = docs.select("id", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    fresh = docs.filter("text IS NOT NULL").withColumn("id", F.concat("id", F.lit("x")))
    out = vectors.embed_and_upsert(old, fresh, "text", lambda texts: [[float(len(t)), float(t.count("_"))] for t in texts])
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("size"), F.get("embedding", F.lit(1)).cast("double").alias("signs"))


QUERIES = (
    store_round_trip, store_append, store_upsert, store_dropped, graph_round_trip, jsonl_round_trip, dead_letters, answers_appended, streamed_documents, key_list, point_lookup, newest_rows, safe_names, tasks_done,
    chunk_segments, chunk_time_ranges, segments_in_order, evidence_listing, evidence_marked, text_composed, prompts, yes_answers, cosine_pairs, cache_keys, judge_valid, results_parsed, query_count,
    extraction_records, extraction_counts, merged_with_existing, nodes_found, node_and_edge, attributes_merged, clusters_attached, level_counts, edges_in_order, entity_hits, first_hits, resolved_mentions, vectors_embedded,
)

_REL, _CTL = graph_queries._REL, r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]'"
_CLOCK = "({0} // 3600) || ':' || (({0} % 3600) // 60) || ':' || ({0} % 60)"
_MEM = """mem AS (SELECT 'S' || s_suppkey AS entity_name, 0 AS level, 'R' || n_regionkey AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey
          UNION ALL SELECT 'S' || s_suppkey, 1, 'N' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_CHUNK_SEGMENTS = "SELECT DISTINCT unnest(video_segment_id) AS segment_id FROM chunks"
_RECORDS = """p AS (SELECT *, CASE p_size % 3 WHEN 0 THEN p_size || '.' WHEN 1 THEN '-.' || p_size ELSE p_size || 'e1' END AS w FROM part)"""

SQL = {
    "store_round_trip": "SELECT doc_id, source, lang FROM documents",
    "store_append": "SELECT doc_id, source, lang FROM documents UNION ALL SELECT doc_id, 'label', NULL FROM labels",
    "store_upsert": "SELECT vec_id AS id, CAST(label AS DOUBLE) AS value FROM embeddings WHERE vec_id NOT IN (SELECT vec_id * 2 FROM embeddings) UNION ALL SELECT vec_id * 2, CAST(vec_id AS DOUBLE) FROM embeddings",
    "store_dropped": "SELECT count(*) AS n FROM documents WHERE false",
    "graph_round_trip": f"""
        WITH {_REL}, m AS (SELECT upper(p_brand) AS n, p_type AS t, CAST(l_orderkey AS VARCHAR) AS s, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
        t AS (SELECT n, t FROM (SELECT n, t, count(*) AS c, min(seq) AS s FROM m GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY n ORDER BY c DESC, s) = 1)
        SELECT src, tgt, weight, ord FROM edges UNION ALL SELECT t.n, t.t, CAST(count(DISTINCT m.s) AS DOUBLE), 0 FROM t JOIN m ON m.n = t.n GROUP BY 1, 2""",
    "jsonl_round_trip": "SELECT doc_id, source, lang FROM documents WHERE doc_id IS NOT NULL",
    "dead_letters": "SELECT 'no label' AS reason, doc_id FROM labels WHERE toxic IS NULL UNION ALL SELECT 'not a label', doc_id FROM labels WHERE toxic NOT IN (0, 1)",
    "answers_appended": """
        WITH a AS (SELECT collection_id, CASE WHEN source = 'answer_md' THEN 0 ELSE 1 END AS k, max(md5(text)) AS answer FROM documents WHERE collection_id IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY 1, 2)
        SELECT collection_id, answer FROM a QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY k) = 1""",
    "streamed_documents": "SELECT doc_id, max(source) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY 1",
    "key_list": "SELECT doc_id FROM documents",
    "point_lookup": "SELECT doc_id, source, lang FROM documents WHERE doc_id = 7",
    "newest_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5",
    "safe_names": r"SELECT DISTINCT path, regexp_replace(path, '[./\\\- :]', '_', 'g') AS name FROM videos",
    "tasks_done": "SELECT '2:' || n_nationkey AS key, n_nationkey % 4 < 2 AS done FROM nation",
    "chunk_segments": _CHUNK_SEGMENTS,
    "chunk_time_ranges": f"""
        WITH c AS ({_CHUNK_SEGMENTS}), s AS (SELECT DISTINCT segment_id, video_name, start_s, end_s FROM segments)
        SELECT c.segment_id, video_name, coalesce({_CLOCK.format('start_s')}, '') AS start, coalesce({_CLOCK.format('end_s')}, '') AS "end" FROM c LEFT JOIN s ON s.segment_id = c.segment_id""",
    "segments_in_order": "WITH s AS (SELECT DISTINCT segment_id, video_name, segment_index FROM segments) SELECT segment_id, CAST(row_number() OVER (PARTITION BY video_name ORDER BY segment_index, segment_id) AS INTEGER) AS place FROM s",
    "evidence_listing": """
        WITH s AS (SELECT DISTINCT segment_id AS id, segment_index / CAST(7 AS DOUBLE) AS score, md5(coalesce(caption, '')) AS snippet, concat_ws('-', start_s, end_s) AS t FROM segments),
        f AS (SELECT * FROM s ORDER BY id, snippet, t LIMIT 50)
        SELECT string_agg('[' || id || '] (segment, ' || printf('%.3f', coalesce(score, 0)) || ') ' || snippet, chr(10) ORDER BY id, snippet, t) AS listing FROM f""",
    "evidence_marked": "SELECT CAST(vec_id AS VARCHAR) AS id, label < 4 AS validated FROM embeddings",
    "text_composed": f"SELECT doc_id, md5(nfc_normalize(regexp_replace(text, {_CTL}, '', 'g'))) AS text_md5, regexp_replace(source, {_CTL}, '', 'g') AS source FROM documents",
    "prompts": """
        SELECT p_partkey, 'Name: ' || p_name || ', type: ' || p_type || '; ' || p_name || '!' AS prompt, p_name || '-----New Chunk-----' || chr(10) || p_type AS context,
        'user:' || p_name || '|assistant:' || p_brand || '|user:' || p_type AS chat, p_name || chr(10) || p_brand AS lines FROM part""",
    "yes_answers": "SELECT p_partkey, p_size % 4 < 2 AS yes FROM part",
    "cosine_pairs": """
        SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(greatest(0, 1 - a.vec_id / CAST(1000 AS DOUBLE)), 6) AS legacy
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "cache_keys": """SELECT event_id, sha256('{"model":"m","messages":"' || event_type || '"}') AS key FROM events""",
    "judge_valid": "SELECT doc_id, coalesce(max(quality) BETWEEN 1 AND 5, false) AS score_valid, coalesce(max(quality) IN (1, 2), false) AS winner_valid FROM labels WHERE doc_id IS NOT NULL GROUP BY 1",
    "results_parsed": """
        SELECT CAST(doc_id AS VARCHAR) AS custom_id, CASE WHEN max(quality) IN (1, 2) THEN 'good' WHEN doc_id % 8 < 6 THEN 'again' ELSE 'lost' END AS state FROM labels WHERE doc_id IS NOT NULL AND doc_id % 2 = 0 GROUP BY doc_id""",
    "query_count": "SELECT count(DISTINCT split_part(custom_id, '-', 1) || '|' || split_part(custom_id, '++', 2)) AS n_queries FROM votes WHERE custom_id IS NOT NULL",
    "extraction_records": f"""
        WITH {_RECORDS} SELECT CAST(p_partkey AS VARCHAR) AS source_id, 0 AS seq, upper(trim(p_name)) AS a, upper(trim(p_type)) AS b, trim(p_brand) AS description, CAST(NULL AS DOUBLE) AS weight FROM p
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, upper(trim(p_name)), upper(trim(p_brand)), 'd', CASE WHEN regexp_full_match(w, '[-+]?[0-9]*\\.?[0-9]+') THEN CAST(w AS DOUBLE) ELSE 1.0 END FROM p""",
    "extraction_counts": "SELECT 'entities' AS kind, count(*) AS n FROM part UNION ALL SELECT 'relations', count(*) FROM part",
    # the existing description counts as one
    "merged_with_existing": f"""
        WITH {_REL}, old AS (SELECT a, b, sum(w) AS w, string_agg(DISTINCT d, '<SEP>' ORDER BY d) AS d, min(o) AS o FROM rel WHERE o % 2 = 1 GROUP BY 1, 2),
        m AS (SELECT a, b, w, d, o FROM rel WHERE o % 2 = 0 UNION ALL SELECT * FROM old),
        g AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, sum(w) AS weight, string_agg(DISTINCT d, '<SEP>' ORDER BY d) AS description, CAST(min(o) AS INTEGER) AS ord FROM m GROUP BY 1, 2)
        SELECT g.src, g.tgt, g.weight, g.description, e.source_ids, g.ord FROM g JOIN edges e ON e.src = g.src AND e.tgt = g.tgt""",
    "nodes_found": "SELECT 'S' || p_partkey AS entity_name, p_partkey IN (SELECT s_suppkey FROM supplier) AS found FROM part",
    "node_and_edge": f"""
        WITH {_REL} SELECT 'node' AS kind, 'S' || s_suppkey AS name, s_acctbal AS value FROM supplier WHERE s_suppkey = 3
        UNION ALL SELECT * FROM (SELECT 'edge', src || '-' || tgt, weight FROM edges WHERE tgt = 'S1' ORDER BY src LIMIT 1)""",
    "attributes_merged": """
        WITH n AS (SELECT c_custkey * 3 AS k, CASE WHEN c_nationkey > 9 THEN c_nationkey END AS nation, c_mktsegment AS segment FROM customer)
        SELECT coalesce(n.k, s_suppkey) AS k, s_name AS name, coalesce(n.nation, s_nationkey) AS nation, n.segment FROM supplier FULL JOIN n ON n.k = s_suppkey""",
    "clusters_attached": f"""
        WITH {_MEM} SELECT 'S' || s_suppkey AS entity_name, coalesce(string_agg(level || ':' || cluster, ',' ORDER BY level, cluster), '') AS clusters
        FROM supplier LEFT JOIN (SELECT * FROM mem WHERE cluster <> 'N3') m ON m.entity_name = 'S' || s_suppkey GROUP BY 1""",
    "level_counts": f"WITH {_MEM} SELECT level, count(DISTINCT cluster) AS n_clusters, count(DISTINCT entity_name) AS n_nodes FROM mem GROUP BY 1",
    "edges_in_order": "WITH e AS (SELECT DISTINCT 'S' || l_suppkey || ' -> P' || l_partkey AS label FROM lineitem) SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM e",
    "entity_hits": f"""
        WITH {_REL}, d AS (SELECT node, count(*) AS degree FROM ways WHERE tgt <> 'S2' GROUP BY 1)
        SELECT 'S' || p_partkey AS entity_name, p_size AS rank, s_name, coalesce(degree, 0) AS degree FROM part JOIN supplier ON s_suppkey = p_partkey LEFT JOIN d ON d.node = 'S' || p_partkey""",
    "first_hits": "SELECT p_brand AS entity_name, p_size AS rank, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1",
    "resolved_mentions": """
        WITH f AS (SELECT p_partkey % 3 AS batch, p_name AS raw, min(p_brand) AS r FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2),
        e AS (SELECT p_partkey, coalesce(a.r, p_name) AS s, coalesce(b.r, p_brand) AS t FROM part LEFT JOIN f a ON a.batch = p_partkey % 3 AND a.raw = p_name LEFT JOIN f b ON b.batch = p_partkey % 3 AND b.raw = p_brand)
        SELECT p_partkey, 'mention' AS kind, s AS name FROM e UNION ALL SELECT p_partkey, 'edge', s || '-' || t FROM e WHERE s <> t""",
    "vectors_embedded": """
        SELECT 'd' || doc_id AS id, CAST(0 AS DOUBLE) AS size, CAST(0 AS DOUBLE) AS signs FROM documents
        UNION ALL SELECT 'd' || doc_id || 'x', CAST(length(source) AS DOUBLE), CAST(length(source) - length(replace(source, '_', '')) AS DOUBLE) FROM documents WHERE source IS NOT NULL""",
}
