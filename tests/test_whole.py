"""Queries over whole tables leave out no rows of their input."""

import os

import pytest

from kinolake.plans import catalog
from kinolake.plans.base import table
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")


def ids(frame, column):
    return {r[0] for r in frame.select(column).distinct().collect()}


@pytest.mark.parametrize("query,name,key", [("drafts", "documents", "doc_id"), ("mcq_options", "part", "p_partkey")])
def test_every_row_comes_out(spark, query, name, key):
    assert ids(catalog.queries()[query](spark, oracle.FOLDER), key) == ids(table(spark, oracle.FOLDER, name), key)


def test_all_suppliers_are_asked(spark):
    lines = table(spark, oracle.FOLDER, "lineitem").select("l_suppkey", "l_partkey").distinct().collect()
    got = catalog.queries()["node_edges"](spark, oracle.FOLDER).collect()
    assert {tuple(r) for r in got} == {(f"S{r.l_suppkey}", f"P{r.l_partkey}") for r in lines}


def test_largest_component_of_all_lines(spark):
    around = {}
    for r in table(spark, oracle.FOLDER, "lineitem").select("l_suppkey", "l_partkey").distinct().collect():
        around.setdefault(f"S{r.l_suppkey}", set()).add(f"P{r.l_partkey}")
        around.setdefault(f"P{r.l_partkey}", set()).add(f"S{r.l_suppkey}")
    found, seen = [], set()
    for start in sorted(around):
        if start not in seen:
            part, new = {start}, [start]
            while new:
                fresh = around[new.pop()] - part
                part |= fresh
                new += fresh
            seen |= part
            found.append(part)
    assert ids(catalog.queries()["largest_component"](spark, oracle.FOLDER), "entity_name") == max(found, key=len)


def test_all_embeddings_are_evidence(spark):
    out = catalog.queries()["evidence_union"](spark, oracle.FOLDER).filter("type <> 'segment'")
    assert ids(out, "id") == {f"e{i}" for i in ids(table(spark, oracle.FOLDER, "embeddings"), "vec_id")}


def test_recall_of_the_approximate_index(spark):
    exact = {(r.query_id, r.id) for r in catalog.queries()["topk_segments"](spark, oracle.FOLDER).collect()}
    found = catalog.queries()["topk_approximate"](spark, oracle.FOLDER).collect()
    assert len(found) == len(exact) and len(exact & {(r.query_id, r.id) for r in found}) >= 0.9 * len(exact)
