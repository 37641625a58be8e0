"""Functions and operators on small inputs with nulls, ties, copies, empty tables and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinolake.functions import ids, judging, text, tokens, vectors as vf
from kinolake.operators import chunking, evaluation, evidence, graph, providers, resolve, segments, tables, vectors
from kinolake.sources import rejects


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value,want",
    [("5", True), ("-.5", True), ("+3.25", True), ("5.", False), ("1e3", False), ("", False), ("x", False)],
)
def test_float_literals(spark, value, want):
    assert one(spark, value, text.is_float("v")) is want
    assert one(spark, value, text.parse_weight("v")) == (float(value) if want else 1.0)


@pytest.mark.parametrize(
    "function,value,want",
    [
        (text.record_body, "x (a (b) c) d", "a (b) c"), (text.record_body, "none", None), (text.record_body, "(a\rb)", "a\rb"), (text.record_body, "(a\nb)", None),
        (text.json_object_span, 'x {"a":\n{}} y', '{"a":\n{}}'), (text.json_object_span, "none", None), (text.json_array_span, "a [1, [2]] b", "[1, [2]]"),
        (text.clock, "3725", "1:2:5"), (text.strip, " \t\n a b \r\n", "a b"), (text.normal_entity_name, " The Acme Corp", "acme"), (text.normal_entity_name, "Dr. No", "no"),
        (text.ellipsis, "a" * 151, "a" * 150 + "..."), (text.ellipsis, "a" * 150, "a" * 150), (text.clean_for_json, "a\x07é\n", "aé\n"), (text.clean_text, " a&amp;b\n\x85c ", "a&bc"),
        (text.yes, ' "Yes" ', True), (text.yes, "yes indeed", False), (text.updated_draft, "Updated Draft: " + "y" * 51, "y" * 51), (text.updated_draft, "Updated Draft: y", None),
        (text.path_safe, "a/b.c", "a_b_c"), (text.enclose, ' "a" ', '"a"'), (ids.segment_video, "a_b_12", "a_b"), (ids.segment_index, "a_b_12", 12), (ids.segment_index, "a_b", None),
        (ids.video_name, "x/y/a.b.mp4", "a"), (tokens.token_count, " a b\tc\n", 2), (tokens.token_count, None, 0),
    ],
)
def test_text_functions(spark, function, value, want):
    assert one(spark, value, function(F.col("v"))) == want


def test_nulls_stay_null(spark):
    for function in (text.clean_for_json, text.clean_text, text.strip, text.json_object_span, text.normal_entity_name, text.record_body):
        assert one(spark, None, function(F.col("v"))) is None


def test_markers_options_templates(spark):
    assert one(spark, "a<|> b##c<|>", text.split_by_markers("v", ["<|>", "##"])) == ["a", "b", "c"]
    assert one(spark, "a", text.split_by_markers("v", [])) == ["a"]
    got = one(spark, "Pick (A) one B. two\nU.S.A. D) x", text.choice_options("v"))
    assert [o.label for o in got][:2] == ["A", "A"] or [o.label for o in got][0] == "A"
    assert one(spark, "w", text.fill_template("{a}-{b}-{a}", a=F.col("v"), b=F.lit(None).cast("string"))) == "w--w"
    assert [m.role for m in one(spark, ["q", "a", "q"], text.chat_messages("v"), "array<string>")] == ["user", "assistant", "user"]


def test_vectors_expressions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r.s for r in df.select(vf.cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [0.0, None, None]
    assert one(spark, None, vf.score(F.lit(None).cast("double"), F.lit(1.5))) == 0.0 and one(spark, None, vf.score(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.0


def test_judging(spark):
    good = {m: ("Answer 1", "e") for m in judging.WINNER_METRICS}
    rows = [(good,), ({**good, "Depth": ("Answer 3", "e")},), ({"Depth": ("Answer 1", "e")},), (None,), ({**good, "Depth": ("Answer 1", None)},)]
    df = spark.createDataFrame(rows, f"j {judging.WINNER_TYPE}")
    assert [r.ok for r in df.select(judging.valid_winners(F.col("j")).alias("ok")).collect()] == [True, False, False, False, False]


def test_segments(spark):
    videos = spark.createDataFrame([("a", 64.9), ("b", 62.0), ("c", 0.5), ("d", None), ("e", 3.0)], "video_name string, duration_s double")
    got = {}
    for r in segments.plan_segments(videos).collect():
        got.setdefault(r.video_name, []).append((r.start_s, r.end_s))
    assert got == {"a": [(0, 30), (30, 64)], "b": [(0, 30), (30, 62)], "e": [(0, 3)]}
    assert segments.plan_segments(videos.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n int, pos string")
    wanted = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "b")], "pos int, id string")
    got = sorted(tables.get_by_ids(table.drop("pos"), wanted).collect())
    assert [(r.pos, r.id, r.n) for r in got] == [(0, "b", 2), (1, "zz", None), (2, "b", 2)]
    assert [r.id for r in tables.missing_keys(spark.createDataFrame([("a",), ("q",), ("q",), (None,)], "id string"), table).collect()] == ["q"]
    assert sorted((r.id, r.n) for r in tables.upsert(table, spark.createDataFrame([("b", 9, "y"), ("c", 3, "z")], table.schema)).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    merged = tables.merge_attributes(table, spark.createDataFrame([("b", None, "new"), ("c", 5, None)], table.schema), ["id"])
    assert sorted((r.id, r.n, r.pos) for r in merged.collect()) == [("a", 1, "x"), ("b", 2, "new"), ("c", 5, None)]
    store = tables.Store(spark, str(tmp_path))
    assert store.read("t") is None
    store.commit("t", table)
    store.upsert("t", spark.createDataFrame([("a", 7, "w")], table.schema))
    assert sorted((r.id, r.n) for r in store.read("t").collect()) == [("a", 7), ("b", 2)]
    store.drop("t")
    assert store.read("t").count() == 0 and store.read("t").columns == table.columns


def test_packed_chunks(spark):
    rows = [("v", 0, "v_0", "a b c"), ("v", 1, "v_1", "d " * 9), ("v", 2, "v_2", None), ("v", 3, "v_3", "e f"), ("v", 3, "v_3", "e f"), ("w", 0, "w_0", None), (None, 0, "n_0", "x")]
    df = spark.createDataFrame(rows, "video_name string, segment_index int, segment_id string, content string")
    got = {(r.video_name, r.chunk_order_index): (r.tokens, r.video_segment_id) for r in chunking.packed_chunks(df, 5).collect()}
    assert got == {("v", 0): (3, ["v_0"]), ("v", 1): (5, ["v_1", "v_2"]), ("v", 2): (2, ["v_3"]), (None, 0): (1, ["n_0"])}
    assert chunking.packed_chunks(df.limit(0), 5).count() == 0


def test_separator_pieces():
    rng = random.Random(0)
    for _ in range(60):
        value = "".join(rng.choice(["word ", "x. ", "line\n", "para\n\n", "a"]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.choice([(10, 0), (10, 3), (50, 10)])
        runs = chunking.split_at_separators(value)
        assert "".join(t for r in runs for t in r) == value
        pieces = chunking.separator_pieces(value, size, overlap)
        if overlap == 0 and all(len(r) <= size for r in runs):
            assert "".join(t for p in pieces for t in p) == value and all(len(p) <= size for p in pieces)
    assert chunking.separator_pieces(None, 10, 2) == [] and chunking.separator_pieces("a " * 25, 10, 2)[0] == ["a "] * 10


def test_budget(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 1), (1, 1, 11), (1, 2, 1)], "g int, r int, n int")
    assert sorted((r.g, r.r) for r in chunking.budget_prefix(df, ["g"], ["r"], "n", 10).collect()) == [(0, 1), (0, 2)]
    assert chunking.budget_prefix(df, ["g"], ["r"], "n", 0).count() == 0


def test_approximate_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], "id long, embedding array<double>")
    asked = df.filter("id % 30 = 0 and id < 1500").withColumnRenamed("id", "query_id")
    far = spark.createDataFrame([(7777, [1e6] * 16)], "query_id long, embedding array<double>")
    want = {(r.query_id, r.id) for r in vectors.top_k(asked.union(far), df.filter("id < 9000"), 8).collect()}
    vectors.ApproximateIndex.fit(df, 16).save(str(tmp_path / "index"))
    got = vectors.ApproximateIndex.load(spark, str(tmp_path / "index")).top_k(asked.union(far), 8).collect()
    counts = {}
    for r in got:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
    assert set(counts.values()) == {8} and len(counts) == 51
    assert len(want & {(r.query_id, r.id) for r in got}) >= 0.9 * len(want)


def test_blocks_and_ties_of_top_k():
    rng = np.random.default_rng(6)
    q, x = np.round(rng.normal(size=(70, 3))), np.round(rng.normal(size=(500, 3)))
    names = rng.permutation(500)
    near = vectors._Nearest(q, 6, rows=16, columns=33)
    near.add(names[:200], x[:200])
    near.add(names[200:], x[200:])
    norm = lambda m: m / np.where((n := np.sqrt((m * m).sum(1))) == 0, 1, n)[:, None]
    s = norm(q) @ norm(x).T
    for i in range(70):
        block, row = divmod(i, 16)
        sims, found = near.best[block][0][row], near.best[block][1][row]
        order = np.lexsort((names, -np.round(s[i], 12)))[:6]
        assert np.allclose(np.sort(sims)[::-1], s[i][order])
        assert len(set(found.tolist())) == 6


def top_k_by_definition(queries, vectors, k, threshold=None):
    """All pairs in expressions alone."""
    pairs = vectors.join(F.broadcast(queries.select("query_id", F.col("embedding").alias("_q"))), how="cross")
    scored = pairs.select("query_id", "id", vf.cosine(F.col("embedding"), F.col("_q")).alias("similarity")).filter(F.col("similarity").isNotNull())
    if threshold is not None:
        scored = scored.filter(F.col("similarity") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def test_top_k_equals_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(200)] + [(900, None), (901, [0.0] * 6), (902, [1.0]), (903, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = df.filter("id % 40 = 0").select(F.col("id").alias("query_id"), "embedding")
    for threshold in (None, 0.2):
        got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(asked, df, 7, threshold).collect()}
        rounded = df.filter("id <> 903")
        want = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in top_k_by_definition(asked, rounded, 7, threshold).collect()}
        sims = {(r.query_id, r["rank"]): r.similarity for r in vectors.top_k(asked, df, 7, threshold).collect()}
        assert set(got) == set(want) and all(abs(sims[k] - want[k][1]) < 1e-9 for k in got)
    assert vectors.top_k(asked, df.limit(0), 7).count() == 0 and vectors.top_k(asked.limit(0), df, 7).count() == 0


def test_parse_and_merge(spark):
    answer = '("entity"<|>ann &amp; co<|>org<|>d1)##("entity"<|> <|>x<|>y)##("relationship"<|>Bob<|>Ann<|>r<|>5.)##("relationship"<|>Ann<|>Bob<|>s<|>2)##broken##("entity"<|>BOB<|>p<|>d2)<|COMPLETE|>'
    answers = spark.createDataFrame([("c1", answer), ("c2", None), ("c3", "")], "chunk_id string, answer string")
    mentions, relations = graph.parse_records(answers)
    # upper case comes first, so the reference in the name keeps its upper-case form
    assert sorted(r.entity_name for r in mentions.collect()) == ["ANN &AMP; CO".replace("&AMP;", "&"), "BOB"]
    edges = graph.merge_edges(relations)
    row = edges.collect()
    assert [(r.src, r.tgt, r.weight, r.ord) for r in row] == [("ANN", "BOB", 3.0, 1)]
    nodes = graph.merge_nodes(mentions)
    lost = graph.missing_endpoints(edges, nodes).collect()
    assert [(r.entity_name, r.entity_type) for r in lost] == [("ANN", graph.UNKNOWN)]
    again = {r.weight for r in graph.merge_edges(relations, edges).collect()}
    assert again == {6.0}


def test_all_names_of_a_text(spark):
    names = [f"Name{chr(97 + i)}" for i in range(26)] + ["Last"]
    answers = spark.createDataFrame([("c", providers.name_extractor(" met ".join(names)))], "chunk_id string, answer string")
    entities, relations = graph.parse_records(answers)
    assert {r.entity_name for r in entities.collect()} == {n.upper() for n in names}
    assert {(r.src_id, r.tgt_id) for r in relations.collect()} == {(a.upper(), b.upper()) for a, b in zip(names, names[1:])}


def test_type_ties_and_existing(spark):
    rows = [("A", "x", "d", "1", 2), ("A", "y", "d", "2", 1), (None, "z", "d", "3", 0)]
    mentions = spark.createDataFrame(rows, "entity_name string, entity_type string, description string, source_id string, seq long")
    assert [(r.entity_name, r.entity_type) for r in graph.merge_nodes(mentions).collect()] == [("A", "y")]
    old = spark.createDataFrame([("A", "z", "e", ["9"]), ("B", "q", "f", [])], "entity_name string, entity_type string, description string, source_ids array<string>")
    got = {r.entity_name: r for r in graph.merge_nodes(mentions, old).collect()}
    assert got["A"].entity_type == "y" and got["A"].description == "d<SEP>e" and got["A"].source_ids == ["1", "2", "9"] and got["B"].entity_type == "q"


def test_degrees_and_components(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("self", "self")]
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "src string, tgt string").distinct()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.entity_name: r.component for r in graph.components(links).collect()}
    assert got == {x: find(x) for p in pairs for x in p}
    assert {r.entity_name: r.degree for r in graph.node_degree(links).collect()}["self"] == 2
    assert graph.components(links.limit(0)).count() == 0


def test_resolution():
    import pandas as pd

    rows = pd.DataFrame({"chunk_order": [0, 0, 12, 12, 25], "entity_name": ["The Acme", "Bolt", "acme corp.", "Cog", "ACME"], "description": ["x", None, "y", "z", "w"]})
    out = resolve.resolve_run(rows, providers.hash_embedder(8), batch_size=1)
    names = dict(zip(out["raw_name"], out["resolved_name"]))
    assert names["acme corp."] == "The Acme" and names["ACME"] == "The Acme" and names["Cog"] in ("Cog", "Bolt", "The Acme")
    assert len(resolve.resolve_run(rows.head(0), providers.hash_embedder(8))) == 0
    small = resolve.Memory(1)
    small.see("a", "", None, 1)
    small.see("b", "", None, 2)
    small.evict()
    assert list(small.rows) == ["b"]


def test_evidence(spark):
    hits = spark.createDataFrame([("a", 0.5, "x" * 400, 1), ("b", None, None, 2)], "id string, score double, content string, ord long")
    pool = evidence.union_in_order([evidence.text_evidence(hits), evidence.text_evidence(hits)])
    rows = evidence.dedup(pool).collect()
    assert sorted((r.id, r.branch) for r in rows) == [("a", 0), ("b", 0)]
    assert max(len(r.snippet) for r in evidence.public(pool).collect()) == 300
    assert "[a] (text, 0.500)" in evidence.listing(evidence.dedup(pool), ("ord",)).first().listing
    cited = evidence.check_citations(spark.createDataFrame([("a",), ("zz",)], "id string"), pool)
    assert sorted((r.id, r.valid) for r in cited.collect()) == [("a", True), ("zz", False)]
    filt = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "c", False), (2, "d", None)], "g int, id string, keep boolean")
    assert sorted(r.id for r in evidence.relevant_or_all(filt, ["g"], "keep").collect()) == ["a", "c", "d"]


def test_evaluation(spark):
    tasks = evaluation.build_tasks(spark.createDataFrame([(1, 10), (2, 20)], "part int, tokens int"), 2)
    assert sorted(r.key for r in tasks.collect()) == ["1:1", "1:2", "2:1", "2:2"]
    ok = {r.key: r.may_submit for r in evaluation.may_submit(tasks, 2, 100, 3).collect()}
    assert ok == {"1:1": True, "1:2": True, "2:1": False, "2:2": False}
    pairs = evaluation.both_orders(spark.createDataFrame([("1", "d", 3, "m", "n")], "collection_id string, description string, query int, a string, b string"), "a", "b")
    assert sorted(r.custom_id for r in pairs.collect()) == ["1-d++query3++m++n++ori", "1-d++query3++n++m++rev"]


def test_record_reasons(spark):
    judged = '"{' + ", ".join(f'""{c}"": {{""Winner"": ""Answer 1"", ""Explanation"": ""a, b""}}' for c in rejects.CRITERIA) + '}"'
    cid = "1-x++query2++a++b++ori"
    good = f"{cid},1,m,,2025-01-31T00:00:00,{judged}"
    rows = {
        0: (good, None), 1: (good + "\r", None), 2: (None, "column_count"), 3: ("", "column_count"), 4: (good + ",", "column_count"), 5: ('"open,1', "quoting"), 6: ('"a"b,1', "quoting"), 7: ('a"b,c', "quoting"),
        8: (good.replace(",1,m", ",01,m"), "invalid_value"), 9: (good.replace("01-31", "02-30"), "invalid_value"), 10: (good.replace("T00:", "T24:"), "invalid_value"), 11: (good.replace("Answer 1", "answer 1", 1), "invalid_value"),
        12: (good.replace('}"', ',}"'), "invalid_value"), 13: (f'{cid},7,"m\n""q"", x",12,2025-01-31T23:59:59,{judged}', None), 14: (good.replace(cid, "1-x++query2++a++ori"), "invalid_value"), 15: (good.replace(",m,,", ",m,1.0,"), "invalid_value"),
        16: ("﷒n,1,m,5,t,c", "invalid_value"), 17: (good.replace("a, b", "z" * 3_000_000, 1), None),
        18: (good.replace(",1,m,,", f",{'7' * 40},m,{'8' * 39},"), None), 19: (good.replace(",1,m", ",+1,m"), "invalid_value"), 20: (good.replace("T00:00:00", " 00:00:00"), "invalid_value"), 21: (good.replace("T00:00:00", "T00:00:00Z"), "invalid_value"),
        22: (good.replace(",1,m", ",x,m") + ",,", "column_count"), 23: (good.replace(",m,,", ',m,"",'), None), 24: (good.replace("2025-01-31", "0000-01-31"), "invalid_value"), 25: (good.replace(",1,m", ",,m"), "invalid_value"),
    }
    data = [(k, "f", v[0], "clash") for k, v in rows.items()] + [(5, "f", rows[5][0], "clash")]
    loaded = rejects.load_records(spark.createDataFrame(data, "line_id long, file_name string, line_text string, reason string"))
    bad = rejects.rejected(loaded).collect()
    assert len(bad) == sum(v[1] is not None for v in rows.values())
    assert {r.line_id: r.reason for r in bad} == {k: v[1] for k, v in rows.items() if v[1]}
    typed = {r.line_id: r for r in rejects.accepted(loaded).collect()}
    assert set(typed) == {k for k, v in rows.items() if v[1] is None}
    assert typed[13].model == 'm\n"q", x' and int(typed[13].prompt_tokens) == 12 and typed[0].prompt_tokens is None
    assert typed[0].verdicts["Depth"]["Explanation"] == "a, b"
    # no type holds 40 digits: the text is kept
    assert typed[18].run is None and typed[18].run_text == "7" * 40 and typed[18].prompt_tokens_text == "8" * 39 and typed[0].run_text == "1"
    assert any("finished_at" in r.detail for r in bad if r.line_id == 9)
