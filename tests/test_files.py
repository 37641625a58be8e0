import json

import pytest

from kinolake.functions import text
from kinolake.operators import evaluation, tables
from kinolake.operators.tables import Store
from kinolake.sources import files


def test_listing_and_questions(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    for name in ("b.cut.mp4", "sub/a.MKV", "notes.txt"):
        (tmp_path / "v" / name).write_bytes(b"12345")
    got = files.list_videos(spark, str(tmp_path / "v")).collect()
    assert [(r.video_name, r.bytes) for r in got] == [("b", 5), ("a", 5)]
    data = {"7": [{"description": "d", "type": "lecture", "video_url": ["u1", "u2"], "questions": [{"id": 0, "question": "q"}]}], "8": []}
    (tmp_path / "q.json").write_text(json.dumps(data, indent=1))
    questions = files.read_questions(spark, str(tmp_path / "q.json"))
    rows = {r.collection_id: r for r in questions.collect()}
    assert rows["7"].questions[0].question == "q" and rows["8"].questions is None
    files.write_urls(questions, str(tmp_path / "urls"))
    assert spark.read.text(str(tmp_path / "urls")).count() == 2


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "custom_id string, n int")
    files.write_jsonl(rows, str(tmp_path / "j"))
    (tmp_path / "j" / "more.json").write_text('{broken\n\n{"n": 3}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "j"), "custom_id string, n int")
    assert sorted((r.custom_id, r.n) for r in good.collect()) == [("a", 1), ("b", None)]
    assert sorted(r.value for r in bad.collect()) == ['{"n": 3}', '{broken']


def test_answers_and_dead_letters(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "id int, answer string"
    files.append_answers(store, "answers", spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], schema), ["id"])
    files.append_answers(store, "answers", spark.createDataFrame([(2, "other"), (3, "z")], schema), ["id"])
    assert sorted((r.id, r.answer) for r in store.read("answers").collect()) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError):
        files.append_answers(store, "answers", spark.createDataFrame([(4, " ")], schema), ["id"])
    files.keep_dead_letters(store, spark.createDataFrame([(4, None)], schema), "blank")
    files.keep_dead_letters(store, spark.createDataFrame([(5, None)], schema), "blank")
    assert [json.loads(r.row)["id"] for r in store.read("dead_letter").orderBy("row").collect()] == [4, 5]


def test_store_versions_appends_and_reset(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), keep=2, most_parts=3)
    assert store.read("t") is None and store.read("t", "id int").count() == 0
    rows = lambda *v: spark.createDataFrame([(i,) for i in v], "id int")
    store.append("t", rows(1))
    old = store.read("t")
    store.append("t", rows(2, 3))
    assert old.count() == 1 and sorted(r.id for r in store.read("t").collect()) == [1, 2, 3]
    for k in range(4, 9):
        store.append("t", rows(k))
    assert sorted(r.id for r in store.read("t").collect()) == list(range(1, 9))
    kept = [f for f in store._names("t") if f.startswith("v-")]
    assert len(kept) == 2 and len([f for f in store._names("t") if f.startswith("p-")]) <= 7
    store.upsert("t", rows(8, 9))
    assert sorted(r.id for r in store.read("t").collect()) == list(range(1, 10))
    store.append("t", spark.createDataFrame([(10, "x")], "id int, more string"))
    assert store.read("t").filter("more = 'x'").count() == 1 and store.read("t").count() == 10
    store.commit("other_tm", rows(1))
    assert store.tables() == ["other_tm", "t"] and store.reset("*_tm") == ["other_tm"] and store.tables() == ["t"]
    store.drop("t")
    assert store.read("t").count() == 0


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = tables.global_rank(df, ["k", "id"], "place").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((i % 7, i) for i in range(1000)) and sorted(r.place for r in got) == list(range(1000))
    assert tables.global_rank(df.limit(0), ["k"]).count() == 0


def test_batch_output(spark, tmp_path):
    line = lambda i, a: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": a}}]}}})
    (tmp_path / "o.jsonl").write_text("\n".join([line("a", "x"), line("b", "y"), "{broken"]))
    good, bad = files.batch_output_to_map(spark, str(tmp_path))
    assert {r.custom_id: r.answer for r in good.collect()} == {"a": "x", "b": "y"} and bad.count() == 1


def test_results_are_parsed_and_asked_again(spark):
    from pyspark.sql import functions as F

    from kinolake.functions import judging

    good = json.dumps({m: {"Winner": "Answer 1", "Explanation": "e"} for m in judging.WINNER_METRICS})
    rows = [("a", "Sure: " + good, 1), ("a", good, 2), ("b", good.replace("Answer 1", "Answer 3"), 2), ("c", "nothing", 6), ("z", good, 1), ("d", None, 1)]
    answers = spark.createDataFrame(rows, "custom_id string, answer string, tries int")
    requests = spark.createDataFrame([(c,) for c in "abcd"], "custom_id string")
    ok, again, lost = evaluation.parse_results(answers, requests, judging.valid_winners(F.col("judged")), judging.WINNER_TYPE)
    assert [r.custom_id for r in ok.collect()] == ["a"] and {r.custom_id: r.tries for r in again.collect()} == {"b": 2, "d": 1} and [r.custom_id for r in lost.collect()] == ["c"]
    ids_ = spark.createDataFrame([("1-x++query1++a++b++ori",), ("1-x++query1++b++a++rev",), ("2-x++query1++a++b++ori",)], "custom_id string")
    assert evaluation.query_count(ids_).first().n_queries == 2


def test_nested_cleaning(spark):
    df = spark.createDataFrame([(("a\x01b", ["c\x02", None], {"k\x03": "v\x04"}, 5),), (None,)], "s struct<a: string, b: array<string>, c: map<string, string>, d: int>")
    got = [r.x for r in df.select(text.clean_nested(df.s, df.schema["s"].dataType).alias("x")).collect()]
    assert got[1] is None and got[0].a == "ab" and got[0].b == ["c", None] and got[0].c == {"k\x03": "v"} and got[0].d == 5


def test_tokenizers(spark):
    import os

    from kinolake.functions import tokens

    lossless = tokens.Lossless()
    for t in ("", "a", " a  b\n", "\n\n", "x y\tz "):
        assert lossless.decode(lossless.encode(t)) == t
    assert len(lossless.encode(" a  b\n")) == 2
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokens.count_with(lossless, "t")).collect()] == [3, 0, 0]
    assert [r[0] for r in df.select(tokens.first_with(lossless, "t", 2)).collect()] == ["a b", None, ""]
    found = [os.path.join(d, f) for d, _, names in os.walk("/opt/tokenizers") for f in names if f == "tokenizer.json"]
    if found:
        public = tokens.FromFile(sorted(found)[0])
        assert df.select(tokens.count_with(public, "t")).first()[0] >= 3


def test_hierarchical_communities(spark):
    from kinolake.operators import graph

    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 0.5), ("c0", "d0", 0.5), ("b1", "c1", 0.01)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src string, tgt string, weight double")
    got = graph.cluster(edges).collect()
    levels = sorted({r.level for r in got})
    of = {(r.level, r.entity_name): r.cluster for r in got}
    assert levels[0] == 0 and len(levels) >= 1 and all(len({of[lv, f"{g}{i}"] for i in range(5)}) == 1 for lv in levels for g in "abcd")
    for lv in levels[1:]:  # a cluster lies in one of the level above
        assert len({(of[lv, n], of[lv - 1, n]) for _, n in of}) == len({of[lv, n] for _, n in of})
    counts = {r.level: r.n_clusters for r in graph.level_counts(graph.cluster(edges)).collect()}
    assert counts[levels[-1]] >= counts[0]
    with pytest.raises(ValueError):
        graph.cluster(edges, "leiden")
    assert graph.cluster(edges, "components").select("cluster").distinct().count() == 1
