import os

import pandas as pd
import pytest

from kinolake.operators import graph, providers, resolve, vectors
from kinolake.plans import runner
from kinolake.plans.engine import FAILED, Engine, Models
from kinolake.plans.refine import Settings, State, Turn, cited_ids, refine_once, rows_of, run, updated, verdict_of
from kinolake.streaming.ingest import unanswered

ROWS = [
    ("tour_a_0", "tour_a", 0, 0, 30, "Caption:\nThe guide Velmin opens the tram near Dromik\nTranscript:\nx\n\n"),
    ("tour_a_1", "tour_a", 1, 30, 60, "Caption:\nThe weaver Sokren paints the harbour with Velmin\nTranscript:\ny\n\n"),
    ("b_0", "b", 0, 0, 30, "Caption:\nDromik repairs the lantern\nTranscript:\nz\n\n"),
    ("b_1", "b", 1, 30, 60, None),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, str(tmp_path_factory.mktemp("tables")))
    frame = spark.createDataFrame(ROWS, "segment_id string, video_name string, segment_index int, start_s bigint, end_s bigint, content string")
    assert out.ingest(frame).count() == 2
    return out, frame


def test_ingest_is_incremental(engine):
    out, frame = engine
    before = {(r.src, r.tgt): r.weight for r in out._read("edges").collect()}
    assert out.ingest(frame).count() == 0
    assert {(r.src, r.tgt): r.weight for r in out._read("edges").collect()} == before
    assert out.store.read("segments").count() == 4


def test_context(engine):
    out, _ = engine
    rows = out.retrieve("Who repairs the lantern with Dromik?").collect()
    assert {r.kind for r in rows} == {"chunk", "segment"}
    assert [r.id for r in sorted((r for r in rows if r.kind == "segment"), key=lambda r: r.place)][0] == "b_0"
    assert "lantern" in out.prompt("Who repairs the lantern with Dromik?")
    with pytest.raises(ValueError):
        out.retrieve("x", "global")


def test_evidence_and_loop(engine):
    out, _ = engine
    pool = rows_of(out.retrieve("Who repairs the lantern with Dromik?", "evidence"))
    assert len(pool) == len({e["id"] for e in pool}) <= 24 and {e["type"] for e in pool} >= {"text", "segment"}
    calls = []

    def model(role, messages, temperature):
        calls.append(role)
        if role == "defender" and calls.count("defender") == 1:
            return Turn("", [("search_graph", {"query": "Velmin"})])
        return Turn("Updated Draft: " + "long enough " * 10 if role == "defender" else '{"Answer": "A"}')

    tools = {"search_graph": lambda q: rows_of(out.graph_evidence(q))}
    verdict, state = run(model, "q", pool, tools, Settings(max_rounds=2, multiple_choice=True))
    assert verdict == {"answer": "A", "rationale": "", "confidence": 1.0} and state.tool_calls == 1 and state.rounds == 2
    verdict, state = run(model, "q", pool, tools, Settings(max_rounds=0))
    assert state.rounds == 0 and len(state.transcript) == 1


SEGMENTS = "segment_id string, video_name string, segment_index int, start_s bigint, end_s bigint, content string"


class Counting:
    """An embedder that writes down what it is asked, in a file, since workers do the asking."""

    def __init__(self, path):
        self.path, self.inner = path, providers.hash_embedder()

    def __call__(self, texts):
        with open(self.path, "a") as out:
            out.writelines(repr(t) + "\n" for t in texts)
        return self.inner(texts)

    def seen(self):
        lines = open(self.path).read().splitlines() if os.path.exists(self.path) else []
        if lines:
            os.remove(self.path)
        return lines


def test_second_ingest_embeds_only_what_is_new(spark, tmp_path):
    counting = Counting(str(tmp_path / "asked"))
    out = Engine(spark, str(tmp_path / "t"), Models(embed=counting))
    assert out.ingest(spark.createDataFrame(ROWS, SEGMENTS)).count() == 2
    counting.seen()
    more = [("c_0", "c", 0, 0, 30, "Caption:\nVelmin follows Krasto\nTranscript:\n\n\n"), ROWS[0]]
    fresh = out.ingest(spark.createDataFrame(more, SEGMENTS)).collect()
    asked = counting.seen()
    assert len(fresh) == 1 and out.store.read("segments").count() == 5 and out.store.read("segment_vectors").count() == 4
    # one segment, one chunk, and the entities named in the new chunk
    assert len(asked) == len(set(asked)) <= 7 and not any("SOKREN" in a or "HARBOUR" in a for a in asked), asked
    assert out.ingest(spark.createDataFrame(more, SEGMENTS)).count() == 0 and counting.seen() == []
    changed = [("b_0", "b", 0, 0, 30, "Caption:\nDromik sells the lantern\nTranscript:\nz\n\n")]
    assert out.ingest(spark.createDataFrame(changed, SEGMENTS)).count() == 1
    assert out.store.read("segments").filter("segment_id = 'b_0'").first().content == changed[0][5] and out.store.read("segments").count() == 5


def test_failures_become_dead_letters_and_can_be_resumed(spark, tmp_path):
    def broken(text):
        if "Sokren" in text:
            raise TimeoutError("no answer")
        return providers.name_extractor(text)

    rows = spark.createDataFrame(ROWS, SEGMENTS)
    with pytest.raises(RuntimeError, match="TimeoutError"):
        Engine(spark, str(tmp_path), Models(extract=broken)).ingest(rows)
    letters = Engine(spark, str(tmp_path)).store.read("dead_letter").collect()
    assert len(letters) == 1 and "Sokren" in letters[0].row
    assert Engine(spark, str(tmp_path)).ingest(rows).count() == 2


def test_gleaning_and_summary():
    calls = []
    glean = lambda history: calls.append(len(history)) or f"##more{len(calls)}"
    assert providers.extract_and_glean("t", lambda t: "first", glean, lambda h: ' "Yes" ', 3) == "first##more1##more2##more3" and calls == [2, 4, 6]
    assert providers.extract_and_glean("t", lambda t: "first", glean, lambda h: "no", 3).count("more") == 1
    assert providers.extract_and_glean("t", lambda t: "first", glean, None, 0) == "first"
    assert providers.keep_first("n", ["a b", "c d", "e"], 5) == "a b<SEP>c d"


def test_long_descriptions(spark):
    rows = spark.createDataFrame([("A", "x " * 499), ("B", "x " * 400 + "<SEP>" + "y " * 200), ("C", None)], "entity_name string, description string")
    got = {r.entity_name: r.description for r in graph.long_descriptions(rows, lambda n, parts: f"{n} of {len(parts)}").collect()}
    assert got["A"] == "x " * 499 and got["B"] == "B of 2" and got["C"] is None


def test_memory_mode_and_reindex(spark, tmp_path):
    rows = [(f"v_{i}", "v", i, 30 * i, 30 * i + 30, f"Caption:\n{'The ' if i % 2 else ''}{name} near Dromik " + "w " * 1190 + "\nTranscript:\n\n\n") for i, name in enumerate(["Velmin", "Sokren", "Velmins", "Krasto"])]
    out = Engine(spark, str(tmp_path), suffix="_tm", memory=True)
    assert out.ingest(spark.createDataFrame(rows, SEGMENTS)).count() == 4
    names = {r.entity_name for r in out._read("nodes").collect()}
    assert {"VELMIN", "DROMIK"} <= names and out._read("edges").filter("src = tgt").count() == 0
    before = {(r.entity_name, r.description) for r in out._read("nodes").collect()}
    weights = {(r.src, r.tgt): r.weight for r in out._read("edges").collect()}
    assert out.reindex_entities() == len(before)
    assert {(r.entity_name, r.description) for r in out._read("nodes").collect()} == before
    assert {(r.src, r.tgt): r.weight for r in out._read("edges").collect()} == weights
    assert out.store.read("segments").count() == 4 and out.store.read("nodes") is None
    assert out.ingest(spark.createDataFrame([("w_0", "w", 0, 0, 30, "Caption:\nVelmin and Branuk\nTranscript:\n\n\n")], SEGMENTS)).count() == 1
    assert "BRANUK" in {r.entity_name for r in out._read("nodes").collect()}


def test_stored_names_are_candidates():
    mentions = pd.DataFrame({"chunk_order": [0, 10], "entity_name": ["Zor", "Zorr"], "description": ["a b c d", "a b c e"], "seq": [0, 0], "known": [None, [{"name": "Zoran", "description": ""}]]})
    offered = []
    out = resolve.resolve_run(mentions, providers.hash_embedder(8), lambda name, text, names: offered.append(names) or "Zoran")
    if offered:
        assert "Zoran" in offered[-1] and out["resolved_name"].tolist()[-1] == "Zoran"
    assert resolve.memory_text(resolve.Memory()) == "Memory is empty."
    memory = resolve.Memory()
    memory.see("N", "d" * 200, None, 1)
    assert resolve.memory_text(memory) == "- N: " + "d" * 150 + "..."


def test_videos_from_providers(spark, tmp_path):
    videos = spark.createDataFrame([("v", "/x/v.mp4", 65.0), ("w", "/x/w.mp4", 20.0), ("v", "/x/v.mp4", 65.0)], "video_name string, path string, duration_s double")
    models = Models(transcribe=lambda path, a, b: f"words at {a}", caption=lambda path, times, heard: f"Velmin seen {len(times)} times")
    out = Engine(spark, str(tmp_path), models)
    assert out.ingest_videos(videos).count() == 2
    rows = {r.segment_id: r for r in out.store.read("segments").collect()}
    assert set(rows) == {"v_0", "v_1", "v_2", "w_0"} and rows["v_1"].content == "Caption:\nVelmin seen 5 times\nTranscript:\nwords at 30\n\n"
    assert out.ingest_videos(videos).count() == 0


def test_runs_resume_where_they_stopped(spark, tmp_path):
    out = Engine(spark, str(tmp_path))
    questions = spark.createDataFrame([("7", "d", "lecture", [(1, "q one"), (2, "q two")])], "collection_id string, description string, type string, questions array<struct<id: int, question: string>>")
    made = []

    def answer(collection, scenario, question):
        if len(made) == 3:
            raise ValueError("stop")
        made.append((scenario, question))
        return f"{scenario} {question}"

    scenarios = ["full_framework", "no_debate"]
    with pytest.raises(RuntimeError, match="after 3"):
        runner.run_all(out.store, questions, scenarios, answer)
    assert runner.run_all(out.store, questions, scenarios, lambda c, s, q: "late") == 1
    assert runner.run_all(out.store, questions, scenarios, answer) == 0
    both = runner.compare(out.store.read("answers"), *scenarios).collect()
    assert len(both) == 2 and sorted(r.query for r in both) == [1, 2]
    assert runner.settings_of("no_debate").max_rounds == 0 and not runner.settings_of("defender_no_tools").use_tools
    with pytest.raises(ValueError):
        runner.settings_of("other")


def test_debate_and_plain_answers(engine):
    out, _ = engine
    model = lambda role, messages, t: Turn('{"Answer": "B"}' if role == "judge" else "text")
    assert runner.debate({True: out, False: out}, model)("7", "no_debate", "Who repairs the lantern with Dromik?") == '{"Answer": "B"}'
    assert "lantern" in runner.plain(out, lambda prompt: prompt)("7", "baseline", "Who repairs the lantern with Dromik?")


def test_table_of_vectors(spark, tmp_path):
    store = Engine(spark, str(tmp_path)).store
    entities = vectors.VectorTable(store, "entities", providers.hash_embedder(), meta=("name",), threshold=0.2)
    assert entities.nearest(["x"], 3).count() == 0
    rows = spark.createDataFrame([("a", "A", "red lantern"), ("b", "B", "blue harbour"), ("c", "C", None), ("a", "A", "red lantern")], "id string, name string, text string")
    entities.put(rows, "text")
    entities.put(spark.createDataFrame([("b", "B2", "green valley")], "id string, name string, text string"), "text")
    entities.put_vectors(spark.createDataFrame([("v", "V", [1.0] * 64)], "id string, name string, embedding array<float>"))
    assert store.read("entities").count() == 3
    got = {(r.query_id, r["rank"]): (r.id, r.name) for r in entities.nearest(["a red lantern", "green valley"], 1).collect()}
    assert got == {(0, 1): ("a", "A"), (1, 1): ("b", "B2")}
    assert entities.nearest([], 1).count() == 0


def test_models_are_bound_retried_and_cached(spark, tmp_path):
    tried = []

    def chat(messages, model="", **options):
        tried.append(model)
        if len(tried) == 1:
            raise TimeoutError
        return f"{model}: {messages[-1]['content']}"

    store = Engine(spark, str(tmp_path)).store
    config = providers.ModelConfig(chat, providers.hash_embedder(), "large", "small", store=store)
    ask = [{"role": "user", "content": "q"}]
    assert config.best(ask) == config.best(ask) == "large: q" and config.cheap(ask) == "small: q" and tried == ["large", "large", "small"]
    assert config.flush() == 2 and store.read("answers_cache").count() == 2


def test_messages_are_cleaned():
    assert providers.clean_value([{"a": "x\x01y\n", "b": ("e\u0301", 5, None)}]) == [{"a": "xy\n", "b": ("\u00e9", 5, None)}]
    seen = []
    run(lambda role, messages, t: seen.append(messages) or Turn("t"), "q\x02", [{"id": "1", "type": "text", "score": 0.5, "snippet": "s\x03"}], {}, Settings(max_rounds=0))
    assert "\x02" not in repr(seen) and "x03" not in repr(seen)


def test_cached_answers(spark, tmp_path):
    store, asked = Engine(spark, str(tmp_path)).store, []
    chat = lambda messages, **o: asked.append(messages) or f"a{len(asked)}"
    cached = providers.CachedChat(chat, store)
    ask = [{"role": "user", "content": "x"}]
    assert cached(ask) == cached(ask) == "a1" and cached(ask, temperature=0.5) == "a2" and cached.hits == 1
    assert cached.flush() == 2 and cached.flush() == 0
    again = providers.CachedChat(chat, store)
    assert again(ask) == "a1" and len(asked) == 2


def test_empty_store(spark, tmp_path):
    assert Engine(spark, str(tmp_path)).prompt("anything") == FAILED


def test_loop_limits():
    greedy = lambda role, messages, t: Turn("text", [("search_text", {})])
    state = State("q", [])
    assert refine_once(greedy, {"search_text": lambda q: [{"id": str(state.tool_calls), "type": "text", "score": 0.1, "snippet": "s"}]}, state, "d", "c", Settings()) == "text"
    assert state.tool_calls == 3
    state = State("q", [])
    refine_once(greedy, {}, state, "d", "c", Settings(use_tools=False))
    assert state.tool_calls == 0


def test_parsing():
    assert updated("Updated Draft: a Updated MCQ Analysis: " + "b" * 51) == "b" * 51 and updated("Updated Draft: short") is None
    assert verdict_of('x {"answer": "B", "rationale": "r"} y')["answer"] == "B" and verdict_of("{bad}") is None and verdict_of("[1]") is None
    assert cited_ids("see [a_1] and [b] and [a_1]") == ["a_1", "b"]


def test_unanswered(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    a = spark.createDataFrame([(1, "x"), (2, "  "), (None, "y")], "id int, answer string")
    assert sorted(r.id for r in unanswered(q, a, ["id"]).collect()) == [2, 3]
