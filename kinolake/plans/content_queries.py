"""Queries on segments, chunks, texts and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.functions import ids, judging, text
from kinolake.functions.tokens import token_count
from kinolake.operators import chunking, segments, tables
from kinolake.plans.base import table


def _segments(spark, folder):
    return table(spark, folder, "segments").distinct()


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "source", "lang")


def segment_plan(spark, folder):
    """Segments that each video's length calls for."""
    length = _segments(spark, folder).groupBy("video_name").agg(F.max("end_s").alias("duration_s"))
    plan = segments.plan_segments(length)
    return plan.select("video_name", "segment_index", "start_s", "end_s", text.clock("start_s").alias("start_clock"))


def frame_plan(spark, folder):
    out = segments.frame_times(_segments(spark, folder).select("segment_id", "start_s", "end_s"))
    return out.select("segment_id", F.explode(F.transform("frame_times", lambda t: F.round(t, 6))).alias("frame_s"))


def segment_merge(spark, folder):
    rows = _segments(spark, folder)
    out = segments.merge_information(rows.select("video_name", "segment_index", "start_s", "end_s"), rows.select("video_name", "segment_index", "transcript"), rows.select("video_name", "segment_index", "caption"))
    return out.select("video_name", "segment_index", F.md5("content").alias("content_md5"))


def caption_recovered(spark, folder):
    rows = _segments(spark, folder).withColumn("content", segments.content_of())
    return rows.select("segment_id", segments.caption_of().alias("caption"))


def video_completeness(spark, folder):
    return segments.completeness(_segments(spark, folder))


def videos_with_features(spark, folder):
    return segments.with_features(table(spark, folder, "videos").distinct(), _segments(spark, folder).select("segment_id"), "segment_id")


def segment_ids(spark, folder):
    rows = _segments(spark, folder)
    return rows.select("segment_id", ids.segment_video("segment_id").alias("video_name"), ids.segment_index("segment_id").alias("segment_index"), (ids.segment_id("video_name", "segment_index") == F.col("segment_id")).alias("same"))


def video_names(spark, folder):
    return table(spark, folder, "videos").distinct().select("path", ids.video_name("path").alias("video_name"))


def multi_get(spark, folder):
    wanted = table(spark, folder, "labels").select("doc_id").distinct().select((F.col("doc_id") * 2).alias("doc_id"), F.col("doc_id").alias("pos"))
    got = tables.get_by_ids(_docs(spark, folder), wanted, "doc_id", "pos", ["source", "lang"])
    return got


def filter_keys(spark, folder):
    keys = table(spark, folder, "labels").select((F.col("doc_id") + 500).alias("doc_id"))
    return tables.missing_keys(keys, _docs(spark, folder), "doc_id")


def kv_upsert(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "source", "lang")
    fresh = table(spark, folder, "labels").select((F.col("doc_id") + 500).alias("doc_id"), F.lit("label").alias("source"), F.lit("xx").alias("lang")).distinct()
    return tables.upsert(docs, fresh, "doc_id")


def manifest_merge(spark, folder):
    old = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("lang"))
    return tables.merge_manifest(_docs(spark, folder).select("doc_id", "source", "lang"), old, "doc_id")


def incremental_insert(spark, folder):
    """Chunks of the texts that aren't among the chunks of the first half of the documents."""
    rows = _docs(spark, folder).filter(F.col("text").isNotNull()).select(ids.chunk_id("text").alias("chunk_id"), "doc_id")
    known = rows.filter("doc_id % 2 = 0").select("chunk_id").distinct()
    return tables.last_by_key(tables.only_new(rows.filter("doc_id % 2 = 1"), known, "chunk_id"), "chunk_id", ["doc_id"])


def chunk_fixed(spark, folder):
    out = chunking.fixed_chunks(_docs(spark, folder), size=256, overlap=32)
    return out.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


def chunk_greedy(spark, folder):
    out = chunking.packed_chunks(_segments(spark, folder), 1200)
    return out.select("video_name", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"), F.array_join("video_segment_id", ",").alias("video_segment_id"))


def chunk_dedup(spark, folder):
    docs = _docs(spark, folder).filter(F.col("text").isNotNull())
    out = chunking.dedup_chunks(docs.select(text.strip("text").alias("content"), "doc_id", "source"), ["doc_id"])
    return out.select("chunk_id", "doc_id", "source")


def chunk_separator(spark, folder):
    return chunking.separator_chunks(_docs(spark, folder), size=256, overlap=32)


def token_budget(spark, folder):
    rows = _docs(spark, folder).withColumn("n", token_count("text")).withColumn("grp", F.pmod("doc_id", F.lit(500)))
    return chunking.budget_prefix(rows.select("grp", "doc_id", "n"), ["grp"], ["doc_id"], "n", 600)


def request_batches(spark, folder):
    rows = _docs(spark, folder).select("doc_id", token_count("text").alias("n"), F.pmod("doc_id", F.lit(3)).alias("run"))
    return chunking.batch_requests(rows, ["run"], ["doc_id"], "n", 1000)


def text_cleaning(spark, folder):
    docs = _docs(spark, folder)
    cleaned = F.regexp_replace("text", text.CONTROL_BUT_LINES, "")
    return docs.select("doc_id", F.length(cleaned).cast("bigint").alias("clean_length"), F.md5(cleaned).alias("clean_md5"))


def text_normalised(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.clean_for_json("text")).alias("json_md5"), F.md5(text.clean_text("text")).alias("text_md5"))


def _record(spark, folder):
    """Delimited extraction records from the parts."""
    parts = table(spark, folder, "part")
    record = F.concat(F.lit('("entity"<|>'), "p_name", F.lit(" <|> "), "p_type", F.lit("<|>"), "p_brand", F.lit(")##("), F.lit('"relationship"<|>'), "p_name", F.lit("<|>"), "p_brand", F.lit("<|>d<|>"), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit("."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("-."), "p_size")).otherwise(F.concat("p_size", F.lit("e1"))), F.lit(")<|COMPLETE|>"))
    return parts.select("p_partkey", record.alias("answer"))


def record_parse(spark, folder):
    rows = _record(spark, folder).select("p_partkey", F.posexplode(text.split_by_markers("answer", ["##", "<|COMPLETE|>"])).alias("seq", "r"))
    fields = rows.select("p_partkey", "seq", text.split_by_markers(text.record_body("r"), ["<|>"]).alias("f"))
    last = F.element_at("f", -1)
    return fields.select("p_partkey", "seq", F.size("f").alias("n_fields"), F.get("f", F.lit(0)).alias("kind"), F.get("f", F.lit(2)).alias("third"), F.when(F.size("f") >= 5, text.parse_weight(last)).alias("weight"))


def json_span(spark, folder):
    events = table(spark, folder, "events")
    answer = F.concat(F.lit("Sure: "), "props", F.lit(" done [1, 2]"))
    return events.select("event_id", text.json_object_span(answer).alias("object"), text.json_array_span(answer).alias("array"))


def mcq_options(spark, folder):
    parts = table(spark, folder, "part")
    question = F.concat(F.lit("Which? A) "), "p_name", F.lit("\nB. "), "p_brand", F.lit(" \n(C) "), "p_type", F.lit("\nU.S.A. D) none"))
    options = parts.select("p_partkey", F.posexplode(text.choice_options(question)).alias("pos", "o"))
    return options.select("p_partkey", "pos", F.col("o.label").alias("label"), F.col("o.text").alias("claim"))


def entity_names(spark, folder):
    parts = table(spark, folder, "part")
    raw = F.concat(F.when(F.col("p_size") % 4 == 0, "The ").when(F.col("p_size") % 4 == 1, " Dr.  ").otherwise(""), "p_name", F.when(F.col("p_size") % 3 == 0, " Inc.").when(F.col("p_size") % 3 == 1, " corp").otherwise(""))
    return parts.select("p_partkey", text.normal_entity_name(raw).alias("name"), ids.entity_id(F.upper("p_name")).alias("entity_id"))


def context_rows(spark, folder):
    rows = _segments(spark, folder)
    row = text.csv_row([(F.col("segment_id"), False), (text.clock("start_s"), False), (F.col("end_s"), True), (text.ellipsis("caption", 150), False)])
    return rows.select("segment_id", row.alias("csv"))


def drafts(spark, folder):
    docs = _docs(spark, folder)
    answer = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x Updated Draft: y Updated Draft: "), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Updated MCQ Analysis\n"), "source")).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(text.updated_draft(answer)).alias("draft_md5"))


def verdicts(spark, folder):
    rows = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    answer = F.when(F.col("q") > 3, F.concat(F.lit('{"Answer": "A", "Explanation": "e", "Confidence": '), F.col("q"), F.lit("}"))).otherwise(F.lit('{"answer": "B", "rationale": "r"}'))
    v = judging.verdict(answer)
    return rows.select("doc_id", v["answer"].alias("answer"), v["rationale"].alias("rationale"), v["confidence"].alias("confidence"))


QUERIES = (
    segment_plan, frame_plan, segment_merge, caption_recovered, video_completeness, videos_with_features, segment_ids, video_names, multi_get, filter_keys, kv_upsert,
    manifest_merge, incremental_insert, chunk_fixed, chunk_greedy, chunk_dedup, chunk_separator, token_budget, request_batches, text_cleaning, text_normalised,
    record_parse, json_span, mcq_options, entity_names, context_rows, drafts, verdicts,
)

_TOK = r"regexp_extract_all({0}, '[^ \t\n\r]+')"
_SEG = "seg AS (SELECT DISTINCT * FROM segments)"
_CONTENT = "'Caption:' || chr(10) || coalesce(caption, '') || chr(10) || 'Transcript:' || chr(10) || coalesce(transcript, '') || chr(10) || chr(10)"
_WS = r"'^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$'"

# quoted text of a context row: outer white space goes, then single quotes, then double ones
_QUOTED = r"""'"' || regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '^[\s\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g'), '^''+|''+$', '', 'g'), '^"+|"+$', '', 'g') || '"' """

SQL = {
    "segment_plan": f"""
        WITH {_SEG}, v AS (SELECT video_name, max(end_s) AS d FROM seg GROUP BY 1 HAVING max(end_s) > 0),
        g AS (SELECT video_name, d, unnest(range(0, d, 30)) AS s FROM v),
        k AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY video_name) AS n, max(s) OVER (PARTITION BY video_name) AS last FROM g),
        f AS (SELECT * FROM k WHERE NOT (n > 1 AND d - last < 5 AND s = last))
        SELECT video_name, CAST(i AS INTEGER) AS segment_index, s AS start_s, coalesce(lead(s) OVER (PARTITION BY video_name ORDER BY s), d) AS end_s,
               (s // 3600) || ':' || ((s % 3600) // 60) || ':' || (s % 60) AS start_clock FROM f""",
    "frame_plan": f"WITH {_SEG} SELECT segment_id, round(CAST(start_s AS DOUBLE) + i * (CAST(end_s - start_s AS DOUBLE) / 5), 6) AS frame_s FROM seg, range(0, 5) t(i) WHERE end_s - start_s IS NOT NULL",
    "segment_merge": f"""
        WITH {_SEG} SELECT a.video_name, a.segment_index, md5('Caption:' || chr(10) || coalesce(c.caption, '') || chr(10) || 'Transcript:' || chr(10) || coalesce(b.transcript, '') || chr(10) || chr(10)) AS content_md5
        FROM seg a JOIN seg b ON a.video_name = b.video_name AND a.segment_index = b.segment_index JOIN seg c ON a.video_name = c.video_name AND a.segment_index = c.segment_index""",
    "caption_recovered": f"""
        WITH {_SEG}, t AS (SELECT segment_id, {_CONTENT} AS c FROM seg)
        SELECT segment_id, split_part(substr(c, strpos(c, 'Caption:' || chr(10)) + 9), chr(10) || 'Transcript:', 1) AS caption FROM t""",
    "video_completeness": f"""
        WITH {_SEG} SELECT video_name, count(*) AS n_segments, bool_and(content IS NOT NULL AND NOT coalesce(contains(content, 'Caption:' || chr(10) || 'None'), false)) AS complete,
        coalesce(bool_and(transcript IS NOT NULL AND transcript <> ''), false) AS has_transcripts, coalesce(bool_and(caption IS NOT NULL AND caption <> ''), false) AS has_captions FROM seg GROUP BY 1""",
    "videos_with_features": "SELECT DISTINCT video_name, path FROM videos WHERE video_name || '_0' IN (SELECT segment_id FROM segments)",
    "segment_ids": rf"""
        WITH {_SEG} SELECT segment_id, regexp_replace(segment_id, '_[^_]*$', '') AS video_name, CAST(regexp_extract(segment_id, '_([^_]*)$', 1) AS INTEGER) AS segment_index,
        video_name || '_' || segment_index = segment_id AS same FROM seg""",
    "video_names": "SELECT DISTINCT path, split_part(regexp_extract(path, '[^/]*$'), '.', 1) AS video_name FROM videos",
    "multi_get": "WITH w AS (SELECT DISTINCT doc_id AS pos, doc_id * 2 AS doc_id FROM labels) SELECT w.pos, w.doc_id, d.source, d.lang FROM w LEFT JOIN documents d ON d.doc_id = w.doc_id",
    "filter_keys": "SELECT DISTINCT doc_id + 500 AS doc_id FROM labels WHERE doc_id IS NOT NULL AND doc_id + 500 NOT IN (SELECT doc_id FROM documents)",
    "kv_upsert": """
        WITH f AS (SELECT DISTINCT doc_id + 500 AS doc_id FROM labels WHERE doc_id IS NOT NULL)
        SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT doc_id, 'label', 'xx' FROM f""",
    "manifest_merge": """
        WITH o AS (SELECT doc_id, CAST(max(quality) AS VARCHAR) AS l FROM labels GROUP BY 1)
        SELECT d.doc_id, d.source, coalesce(o.l, d.lang) AS lang FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "incremental_insert": """
        WITH t AS (SELECT 'chunk-' || md5(text) AS chunk_id, doc_id FROM documents WHERE text IS NOT NULL)
        SELECT chunk_id, max(doc_id) AS doc_id FROM t WHERE doc_id % 2 = 1 AND chunk_id NOT IN (SELECT chunk_id FROM t WHERE doc_id % 2 = 0) GROUP BY 1""",
    "chunk_fixed": f"""
        WITH t AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, t, unnest(range(0, len(t), 224)) AS s FROM t)
        SELECT doc_id, CAST(s // 224 AS INTEGER) AS chunk_order_index, CAST(least(256, len(t) - s) AS INTEGER) AS tokens, md5(array_to_string(t[s + 1 : s + 256], ' ')) AS content_md5 FROM s""",
    "chunk_greedy": rf"""
        WITH RECURSIVE {_SEG}, s0 AS (SELECT video_name, segment_index, segment_id, coalesce(content, '') AS content, coalesce({_TOK.format('content')}, []) AS t FROM seg),
        s1 AS (SELECT *, CAST(least(len(t), 1200) AS BIGINT) AS n, CASE WHEN len(t) > 1200 THEN array_to_string(t[1:1200], ' ') ELSE content END AS x,
               row_number() OVER (PARTITION BY video_name ORDER BY segment_index, segment_id, content) AS k FROM s0),
        r AS (SELECT video_name, k, n AS fill, CAST(0 AS BIGINT) AS bin FROM s1 WHERE k = 1
              UNION ALL SELECT s1.video_name, s1.k, CASE WHEN r.fill + s1.n <= 1200 THEN r.fill + s1.n ELSE s1.n END, CASE WHEN r.fill + s1.n <= 1200 THEN r.bin ELSE r.bin + 1 END
              FROM r JOIN s1 ON s1.video_name = r.video_name AND s1.k = r.k + 1),
        g AS (SELECT s1.video_name, CAST(r.bin AS INTEGER) AS chunk_order_index, CAST(sum(s1.n) AS INTEGER) AS tokens, string_agg(s1.x, '' ORDER BY s1.k) AS c, string_agg(s1.segment_id, ',' ORDER BY s1.k) AS video_segment_id
              FROM s1 JOIN r ON r.video_name = s1.video_name AND r.k = s1.k GROUP BY 1, 2)
        SELECT video_name, chunk_order_index, tokens, md5(regexp_replace(c, {_WS}, '', 'g')) AS content_md5, video_segment_id FROM g WHERE tokens > 0""",
    "chunk_dedup": f"""
        WITH t AS (SELECT 'chunk-' || md5(regexp_replace(text, {_WS}, '', 'g')) AS chunk_id, doc_id, source FROM documents WHERE text IS NOT NULL)
        SELECT chunk_id, doc_id, source FROM t QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id DESC) = 1""",
    "token_budget": f"""
        WITH t AS (SELECT doc_id % 500 AS grp, doc_id, CAST(coalesce(len({_TOK.format('text')}), 0) AS INTEGER) AS n FROM documents)
        SELECT grp, doc_id, n FROM t QUALIFY sum(n) OVER (PARTITION BY grp ORDER BY doc_id) <= 600""",
    "request_batches": f"""
        WITH RECURSIVE t AS (SELECT doc_id, CAST(coalesce(len({_TOK.format('text')}), 0) AS INTEGER) AS n, doc_id % 3 AS run, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS k FROM documents),
        r AS (SELECT run, k, n AS fill, 0 AS batch FROM t WHERE k = 1
              UNION ALL SELECT t.run, t.k, CASE WHEN r.fill + t.n <= 1000 THEN r.fill + t.n ELSE t.n END, CASE WHEN r.fill + t.n <= 1000 THEN r.batch ELSE r.batch + 1 END FROM r JOIN t ON t.run = r.run AND t.k = r.k + 1)
        SELECT t.doc_id, t.n, t.run, r.batch FROM t JOIN r ON r.run = t.run AND r.k = t.k""",
    "text_cleaning": r"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g') AS c FROM documents)
        SELECT doc_id, length(c) AS clean_length, md5(c) AS clean_md5 FROM t""",
    "record_parse": r"""
        WITH p AS (SELECT *, CASE p_size % 3 WHEN 0 THEN p_size || '.' WHEN 1 THEN '-.' || p_size ELSE p_size || 'e1' END AS w FROM part)
        SELECT p_partkey, 0 AS seq, 4 AS n_fields, '"entity"' AS kind, trim(p_type) AS third, CAST(NULL AS DOUBLE) AS weight FROM p
        UNION ALL SELECT p_partkey, 1, 5, '"relationship"', trim(p_brand), CASE WHEN regexp_full_match(w, '[-+]?[0-9]*\.?[0-9]+') THEN CAST(w AS DOUBLE) ELSE 1.0 END FROM p""",
    "json_span": r"""
        SELECT event_id, nullif(regexp_extract('Sure: ' || props || ' done [1, 2]', '\{.*\}', 0, 's'), '') AS object,
               nullif(regexp_extract('Sure: ' || props || ' done [1, 2]', '\[.*\]', 0, 's'), '') AS "array" FROM events""",
    "mcq_options": r"""
        WITH q AS (SELECT p_partkey, 'Which? A) ' || p_name || chr(10) || 'B. ' || p_brand || ' ' || chr(10) || '(C) ' || p_type || chr(10) || 'U.S.A. D) none' AS q FROM part),
        e AS (SELECT p_partkey, regexp_extract_all(q, '(?:\(?([A-D])[\)\.])\s*([^\(\n]+)', 1) AS l, regexp_extract_all(q, '(?:\(?([A-D])[\)\.])\s*([^\(\n]+)', 2) AS t FROM q)
        SELECT p_partkey, CAST(i AS INTEGER) AS pos, l[i + 1] AS label, trim(t[i + 1]) AS claim FROM e, LATERAL (SELECT unnest(range(0, len(l))) AS i)""",
    "entity_names": r"""
        WITH r AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'The ' WHEN 1 THEN ' Dr.  ' ELSE '' END || p_name || CASE p_size % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' corp' ELSE '' END AS raw FROM part)
        SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(raw)), '^(the|a|an|mr\.|dr\.)\s+', ''), '\s+(inc\.|llc\.|corp\.?)$', '') AS name, 'ent-' || md5(upper(p_name)) AS entity_id FROM r""",
    "context_rows": rf"""
        WITH {_SEG}, t AS (SELECT segment_id, start_s, end_s, CASE WHEN length(caption) > 150 THEN substr(caption, 1, 150) || '...' ELSE caption END AS caption FROM seg),
        q AS (SELECT segment_id, end_s, coalesce(nullif(concat_ws(':', start_s // 3600, (start_s % 3600) // 60, start_s % 60), ''), '') AS clock, caption FROM t)
        SELECT segment_id, concat_ws(',' || chr(9), {_QUOTED.format('segment_id')}, {_QUOTED.format('clock')}, coalesce(CAST(end_s AS VARCHAR), ''), {_QUOTED.format('caption')}) AS csv FROM q""",
    "drafts": r"""
        WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x Updated Draft: y Updated Draft: ' || text WHEN 1 THEN 'Updated MCQ Analysis' || chr(10) || source ELSE text END AS a FROM documents),
        t AS (SELECT doc_id, CASE WHEN contains(a, 'Updated Draft') THEN list_last(string_split(a, 'Updated Draft')) WHEN contains(a, 'Updated MCQ Analysis') THEN list_last(string_split(a, 'Updated MCQ Analysis')) END AS t FROM a),
        s AS (SELECT doc_id, regexp_replace(t, '^[: \n]+|[: \n]+$', '', 'g') AS s FROM t)
        SELECT doc_id, md5(CASE WHEN length(s) > 50 THEN s END) AS draft_md5 FROM s""",
    "verdicts": """
        WITH r AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
        SELECT doc_id, CASE WHEN q > 3 THEN 'A' ELSE 'B' END AS answer, CASE WHEN q > 3 THEN 'e' ELSE 'r' END AS rationale, CASE WHEN q > 3 THEN CAST(q AS DOUBLE) ELSE 1.0 END AS confidence FROM r""",
}
