import random

import pytest

from kinolake.functions.tokens import token_spans
from kinolake.llm.split import cut_points, split_items, split_text


def sample(rng, n):
    words = []
    for _ in range(n):
        words.append(rng.choice(["a", "bb", "c.", "dd!", "e?", "é", "“x.”"]) + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", "\r\n"]))
    return rng.choice(["", "  ", "\n"]) + "".join(words)


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 3), (10, 9), (64, 16), (1, 0)])
def test_pieces_keep_limit_overlap_and_text(limit, overlap):
    rng = random.Random(limit * 100 + overlap)
    for n in [limit + 1, limit + 2, 2 * limit, 5 * limit + 3, 300]:
        text = sample(rng, n)
        if len(token_spans(text)) <= limit:
            continue
        parts = split_text(text, limit, overlap)
        assert all(p[2] <= limit and p[2] == len(token_spans(p[1])) for p in parts)
        assert [p[0] for p in parts] == list(range(len(parts)))
        whole = parts[0][1]
        for before, after in zip(parts, parts[1:]):
            tail = [before[1][a:b] for a, b in token_spans(before[1])]
            head = [after[1][a:b] for a, b in token_spans(after[1])]
            k = min(overlap, len(tail))
            assert head[:k] == tail[len(tail) - k :]
            whole += after[1][before[4] - after[3] :]
        assert whole == text


def test_cut_on_boundary_where_one_is_in_reach():
    ranks = [0] * 100
    ranks[44] = 1
    ranks[48] = 3
    assert cut_points(ranks, 60, 10)[0] == 49
    ranks = [0] * 200
    ranks[29] = 1  # the only boundary, too early for the minimum count
    ends = cut_points(ranks, 100, 10)
    assert ends[0] == 30 and ends[-1] == 200


def test_no_boundary_gives_balanced_pieces():
    ends = cut_points([0] * 2050, 1024, 128)
    sizes = [ends[0]] + [b - a + 128 for a, b in zip(ends, ends[1:])]
    assert max(sizes) <= 1024 and max(sizes) - min(sizes) <= 2


def test_frame(spark):
    long = "word. " * 5000
    rows = [("a", long, 7, "x"), ("b", None, 1, None), ("c", "", 2, "x"), ("d", "few words", 3, "x"), ("d", "few words", 3, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, chunk_order_index int, boundary string")
    out = split_items(df).collect()
    a = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.chunk_order_index)
    assert len(a) == a[0].n_pieces == -(-(5000 - 128) // 896) and all(r.tokens <= 1024 for r in a)
    assert [(r.chunk_id, r.content, r.tokens, r.n_pieces, r.chunk_order_index) for r in out if r.chunk_id != "a"] == [("b", None, 0, 1, 1), ("c", "", 0, 1, 2), ("d", "few words", 2, 1, 3), ("d", "few words", 2, 1, 3)]
    assert split_items(df.limit(0)).count() == 0


def test_texts_are_cut_once_under_a_filter(spark):
    df = spark.createDataFrame([("a", "w " * 50)], "chunk_id string, content string")
    plan = split_items(df, "content", 16, 4).filter("n_pieces > 1").select("chunk_id").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
