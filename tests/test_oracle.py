import os

import pytest

from kinolake.plans import catalog
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(spark, con, catalog.queries()[name], SQL[name])


def rows(spark, name):
    return catalog.queries()[name](spark, oracle.FOLDER).collect()


def test_chunk_separator_keeps_every_token(spark):
    texts = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in sorted(rows(spark, "chunk_separator"), key=lambda r: (r.doc_id, r.chunk_order_index)):
        assert 0 < r.tokens
        got.setdefault(r.doc_id, []).append(r.content.split())
    for doc_id, words in texts.items():
        seen = {w for part in got.get(doc_id, []) for w in part}
        assert bool(words) == (doc_id in got) and len(seen ^ set(words)) <= 2 * len(got.get(doc_id, []))  # a cut may part a word from its end


def test_text_normalised(spark):
    import hashlib
    import html
    import re
    import unicodedata

    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows(spark, "text_normalised"):
        t = texts[r.doc_id]
        assert r.json_md5 == (None if t is None else md5(unicodedata.normalize("NFC", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t))))
        assert r.text_md5 == (None if t is None else md5(re.sub("[\x00-\x1f\x7f-\x9f]", "", html.unescape(t.strip()))))


def test_communities(spark):
    got = rows(spark, "communities")
    names = {r.entity_name for r in got}
    assert len(got) == len(names) and {r.cluster for r in got} <= names


def test_node_vectors(spark):
    got = rows(spark, "node_vectors")
    assert len({r.entity_name for r in got}) == len(got) > 0
    for r in got:
        v = [float(x) for x in r.embedding.split(",")]
        assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-4


def test_entity_mentions(spark):
    import re

    wanted = {}
    for r in spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").select("doc_id", "text").collect():
        for name in re.findall(r"\b[A-Z][a-z]{3,}\b", r.text or ""):
            wanted.setdefault(name.upper(), set()).add(r.doc_id)
    assert {r.entity_name: r.n_sources for r in rows(spark, "entity_mentions")} == {n: len(d) for n, d in wanted.items()}


def test_entity_resolution(spark):
    parts = spark.read.parquet(f"{oracle.FOLDER}/part.parquet").collect()
    names = {}
    for p in parts:
        names.setdefault(str(p.p_size % 5), set()).add(p.p_name)
    got = rows(spark, "entity_resolution")
    by_batch = {(r.run, r.batch, r.raw_name) for r in got}
    assert len(by_batch) == len(got) and {r.how for r in got} <= {"name", "new", "similar", "decided"}
    for run, seen in names.items():
        assert {r.raw_name for r in got if r.run == run} == seen and {r.resolved_name for r in got if r.run == run} <= seen


def test_every_query_is_compared_or_checked():
    checked = {"chunk_separator", "text_normalised", "communities", "node_vectors", "entity_mentions", "entity_resolution", "topk_approximate"}  # the last in test_whole
    assert set(catalog.queries()) - set(SQL) == checked


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
