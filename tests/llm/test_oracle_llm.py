"""Queries against their SQL; those without are checked against definitions, brute force or each other."""

import os
import re

import numpy as np
import pytest

from kinolake.functions.tokens import token_spans
from kinolake.llm import catalog
from kinolake.llm.neighbours import exact_most_similar
from kinolake.llm.words import words
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
SQL = catalog.oracle_sql()
CHECKED = {
    "p2_nearest", "p2_neighbours", "p3_found", "p3_ranking", "p4_pieces", "p5_containers", "p5_fill", "p6_found", "p6_leaks", "p6_items", "p7_mix", "p7_shares", "p8_found", "p8_scores", "p8_rates",
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(spark, con, catalog.queries()[name], SQL[name])


def test_every_query_is_compared_or_checked():
    assert set(catalog.queries()) - set(SQL) == CHECKED  # p2_nearest in test_neighbours


def rows(spark, name, folder=oracle.FOLDER):
    return catalog.queries()[name](spark, folder).collect()


def read(spark, name, folder=oracle.FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_p2_neighbours_against_brute_force(spark):
    folder = oracle.FOLDER.replace("sf0.001", "sf0.01")
    want = exact_most_similar(read(spark, "vectors", folder).toPandas(), 5)
    got = {}
    for r in rows(spark, "p2_neighbours", folder):
        got.setdefault(r.id, {})[r.other] = r.similarity
    assert got and all(set(near) == {o for o, _ in want[i]} for i, near in got.items())


def test_p3_ranking_and_found(spark):
    ranking = rows(spark, "p3_ranking")
    methods = {r.method for r in read(spark, "methods").collect()}
    by = {}
    for r in ranking:
        by.setdefault(r.metric, []).append(r)
    assert len(by) == 6
    for found in by.values():
        assert {r.method for r in found} == methods and sorted(r.position for r in found) == list(range(1, len(methods) + 1))
        assert abs(sum(r.strength for r in found)) < 1e-6
        order = sorted(found, key=lambda r: r.position)
        assert all(a.strength >= b.strength for a, b in zip(order, order[1:]))
    assert {(r.metric, r.method) for r in rows(spark, "p3_found")} == {(r.metric, r.method) for r in ranking if r.position <= 6}


def test_p4_pieces_give_the_texts_back(spark):
    texts = {(r.chunk_id, r.content) for r in read(spark, "chunks").select("chunk_id", "content").collect()}
    by = {}
    for r in rows(spark, "p4_pieces"):
        by.setdefault(r.chunk_id, []).append(r)
    for chunk_id, content in texts:
        n = len(token_spans(content or ""))
        pieces = sorted((r for r in by[chunk_id] if r.n_pieces > 1 or n <= catalog.CHUNK_LIMIT), key=lambda r: r.chunk_order_index)
        if n <= catalog.CHUNK_LIMIT:
            assert any(r.content == content and r.n_pieces == 1 for r in pieces)
            continue
        distinct = {r.chunk_order_index: r for r in pieces if content[r.char_start : r.char_end] == r.content}
        assert sorted(distinct) == list(range(pieces[0].n_pieces)) and all(r.tokens <= catalog.CHUNK_LIMIT for r in distinct.values())
        for a, b in zip(range(len(distinct)), range(1, len(distinct))):
            repeated = content[distinct[b].char_start : distinct[a].char_end]
            assert len(token_spans(repeated)) == catalog.CHUNK_OVERLAP
        assert distinct[0].char_start == 0 and distinct[len(distinct) - 1].char_end == len(content)


def test_p5_containers_hold_every_segment_once(spark):
    packed = rows(spark, "p5_containers")
    wanted = {(r.segment_id, r.video_name, len(token_spans(r.content or ""))) for r in read(spark, "segments").select("segment_id", "video_name", "content").collect()}
    total, pieces = {}, {}
    for r in packed:
        total[r.video_name, r.container] = total.get((r.video_name, r.container), 0) + r.tokens
        pieces.setdefault((r.segment_id, r.video_name), []).append(r.tokens)
    assert all(v <= catalog.CONTAINER for v in total.values()) and all(total[r.video_name, r.container] == r.fill for r in packed)
    assert {(s, v, sum(t)) for (s, v), t in pieces.items()} == wanted
    assert all(len(t) == 1 or sum(t) > catalog.CONTAINER for t in pieces.values())
    fill = {(r.video_name, r.container): (r.fill, r.n_items) for r in rows(spark, "p5_fill")}
    assert {k: f for k, (f, _) in fill.items()} == total and sum(n for _, n in fill.values()) == len(packed)


def test_p6_finds_every_exact_run(spark, con):
    """Runs of 15 equal words by a plain join of windows in SQL, a part of what is to be found; each pair found holds a run."""
    folder = oracle.FOLDER.replace("sf0.001", "sf0.01")
    grams = r"""(SELECT {0} AS id, unnest(list_transform(range(1, len(w) - 13), lambda i: array_to_string(w[i : i + 14], ' '))) AS g
                FROM (SELECT {0}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM '{1}/{2}.parquet' WHERE text IS NOT NULL) WHERE len(w) >= 15)"""
    exact = con.execute(f"SELECT DISTINCT d.id, i.id FROM {grams.format('doc_id', folder, 'documents')} d JOIN {grams.format('item_id', folder, 'eval_items')} i USING (g)").fetchall()
    leaks = rows(spark, "p6_leaks", folder)
    found = {(r.doc_id, r.item_id) for r in leaks if r.kind == "leaked"}
    assert len(exact) > 20 and set(exact) <= found
    assert found == {(r.doc_id, r.item_id) for r in rows(spark, "p6_found", folder)}
    texts = {r.doc_id: set(words(r.text)) for r in read(spark, "documents", folder).select("doc_id", "text").collect() if r.doc_id in {d for d, _ in found}}
    items = {r.item_id: words(r.text) for r in read(spark, "eval_items", folder).collect()}
    assert all(r.n_words >= 15 and len(set(items[r.item_id]) & texts[r.doc_id]) >= 10 for r in leaks if r.kind == "leaked")
    report = {r.item_id: r.n_leaked for r in rows(spark, "p6_items", folder)}
    assert report == {i: sum(item == i for _, item in found) for i in items}


def test_p7_mix_keeps_budgets_and_repeats(spark):
    mix, shares = rows(spark, "p7_mix"), {r.source: r for r in rows(spark, "p7_shares")}
    targets = {r.source.strip().lower(): r for r in read(spark, "source_targets").collect()}
    assert set(shares) == set(targets) and len({(r.doc_id, r.source, r.lang) for r in mix}) == len(mix)
    used = {}
    for r in mix:
        assert 0 < r.repeats <= targets[r.source].max_repeats
        used[r.source] = used.get(r.source, 0) + r.tokens * r.repeats
    for source, r in shares.items():
        assert r.mix_tokens == used.get(source, 0) <= r.budget <= r.source_tokens * r.max_repeats
    assert {s for s, r in shares.items() if r.short} == {r.source for r in rows(spark, "p7_found")}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1.0)
    assert sum(r.budget for r in shares.values()) <= sum(r.source_tokens for r in shares.values())


def test_p8_scores_found_and_rates(spark):
    folder = oracle.FOLDER.replace("sf0.001", "sf0.01")
    scores = {r.doc_id: r for r in rows(spark, "p8_scores", folder)}
    docs = {r.doc_id: r for r in read(spark, "documents", folder).select("doc_id", "text").collect()}
    assert set(scores) == set(docs) and all(0 <= r.score <= 1 for r in scores.values())
    assert all(scores[i].score == 0 for i, d in docs.items() if not words(d.text))
    found = {r.doc_id for r in rows(spark, "p8_found", folder)}
    least = min(scores[i].score for i in found) if found else 1.0
    assert found == {i for i, r in scores.items() if r.score >= least} and least >= 0.5
    labels = {}
    for r in read(spark, "labels", folder).collect():
        labels.setdefault(r.doc_id, []).append(r.toxic)
    toxic = [scores[i].score for i, v in labels.items() if i in scores and set(v) == {1}]
    clean = [scores[i].score for i, v in labels.items() if i in scores and set(v) == {0}]
    assert np.mean(toxic) > np.mean(clean)
    report = rows(spark, "p8_rates", folder)
    assert sum(r.n_docs for r in report) == len(docs) and sum(r.n_flagged for r in report) == len(found)
    assert all(re.fullmatch(r"\S.*|", r.source) for r in report)
