import os
import random

import pandas as pd
import pytest

from kinolake.llm import catalog
from kinolake.llm.mixing import allocate, budgets, fill, offers, select_mix, shares, short_sources, sized, spend
from tests import oracle


def test_fill_redistributes_by_weight():
    assert fill(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert fill(100, [1, 1, 2], [10, 1000, 1000]) == pytest.approx([10, 30, 60])
    assert fill(100, [1, 1], [10, 20]) == [10, 20]
    assert fill(100, [0, 1], [50, 500]) == [0, 100]


def test_siblings_before_ancestors():
    leaves = pd.DataFrame({"domain": ["a", "a", "b"], "lang": ["en", "en", "en"], "weight": [0.3, 0.2, 0.5], "capacity": [10.0, 1000.0, 1000.0]})
    assert allocate(leaves, 100, ["domain", "lang"]).sort_index().tolist() == pytest.approx([10, 40, 50])
    leaves["capacity"] = [10.0, 20.0, 1000.0]
    assert allocate(leaves, 100, ["domain", "lang"]).sort_index().tolist() == pytest.approx([10, 20, 70])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice(["big_x"] * 8 + [" Small_x ", "rare_y", "other"])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["en", "EN ", "fr", None]), source, "clash"))
    rows += [rows[0], (901, None, "en", "big_x", "clash"), (902, "x y", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget string")


def test_mix(spark, docs):
    targets = spark.createDataFrame([("BIG_x", 0.5, 1), ("small_x", 0.3, 2), ("rare_y", 0.1, 4), ("none_z", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    sizes = sized(docs).cache()
    plan = budgets(sizes, targets).cache()
    mix = select_mix(sizes, plan).cache()
    got = {r.source: r for r in shares(sizes, targets, plan, mix).collect()}
    tokens = sizes.toPandas().groupby("source").tokens.sum()
    total = sum(tokens.get(s, 0) for s in ("big_x", "small_x", "rare_y"))
    for source, share, most in (("big_x", 0.5, 1), ("small_x", 0.3, 2), ("rare_y", 0.1, 4), ("none_z", 0.1, 3)):
        r = got[source]
        assert r.short == (tokens.get(source, 0) * most < share * total)
        assert r.most_repeats <= most and r.mix_tokens <= r.budget <= tokens.get(source, 0) * most
    assert got["small_x"].short and got["none_z"].short and not got["big_x"].short
    assert set(got) == {"big_x", "small_x", "rare_y", "none_z"}
    # what is left of a source's budget is less than any document that could still be added
    used = {(r.doc_id, r.lang): r.repeats for r in mix.collect()}
    repeats = {"big_x": 1, "small_x": 2, "rare_y": 4}
    for source, most in repeats.items():
        epochs = {(r.source, r.lang): r.epochs for r in plan.collect()}
        spare = [r.tokens for r in sizes.filter(sizes.source == source).collect() if r.tokens > 0 and used.get((r.doc_id, r.lang), 0) == epochs.get((source, r.lang)) < most]
        assert got[source].budget - got[source].mix_tokens < min(spare, default=1 << 40)
    # the flag is the allocation's: without its cuts no source is short
    assert {r.source for r in short_sources(plan).filter("short").collect()} == {"small_x", "none_z"}
    from pyspark.sql import functions as F

    assert not any(r.short for r in shares(sizes, targets, plan.withColumn("cut", F.lit(0.0)), mix).collect())
    # prefix against brute force: within each leaf the extra documents are a prefix in order
    frame = mix.toPandas()
    assert frame.doc_id.is_unique
    again = select_mix(sizes, plan).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(frame.sort_values("doc_id").reset_index(drop=True), again)
    other = select_mix(sizes, plan, seed=8).toPandas()
    assert set(other.doc_id) != set(frame.doc_id)


def test_offers_and_leftovers():
    leaves = pd.DataFrame({"domain": ["a", "a", "b"], "lang": ["en", "en", "en"], "weight": [0.3, 0.2, 0.5], "capacity": [10.0, 1000.0, 1000.0]})
    assert offers(leaves, 100, ["domain", "lang"]).sort_index().tolist() == pytest.approx([30, 20, 50])
    assert spend([5, 9, 2], [3, 1, 9], 22) == {9: 1, 5: 2, 2: 1} and spend([5], [3], 4) == {}


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
def test_shares_reach_their_budgets(spark):
    for r in catalog.p7_shares(spark, oracle.FOLDER.replace("sf0.001", "sf0.01")).collect():
        assert r.mix_tokens <= r.budget and r.budget - r.mix_tokens <= 0.01 * r.budget, r


def test_empty(spark, docs):
    targets = spark.createDataFrame([("big_x", 1.0, 1)], "source string, target_share double, max_repeats int")
    sizes = sized(docs.limit(0))
    plan = budgets(sizes, targets)
    mix = select_mix(sizes, plan)
    assert mix.count() == 0
    row = shares(sizes, targets, plan, mix).collect()
    assert len(row) == 1 and row[0].actual_share == 0 and not row[0].short
    assert budgets(sizes, targets.limit(0)).count() == 0
