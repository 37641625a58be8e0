import os

import numpy as np
import pandas as pd
import pytest

from kinolake.llm import catalog
from kinolake.llm.neighbours import Centroids, _blocks, _nearest, decode, encode, exact_most_similar, fit_centroids, most_similar, near_lists, search, similar_pairs
from tests import oracle

DIM = 16


def cloud(n, seed, groups=60):
    """Half of the points in tight groups, half anywhere."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, DIM))
    x = np.concatenate([centers[rng.integers(0, groups, n // 2)] + 0.25 * rng.normal(size=(n // 2, DIM)), rng.normal(size=(n - n // 2, DIM))])
    return x / np.sqrt((x * x).sum(1))[:, None]


def test_codes():
    x = cloud(100, 1)
    y = decode(encode(x), DIM)
    assert np.abs(x - y).max() < 1e-6 and np.abs((x * x[::-1]).sum(1) - (y * y[::-1]).sum(1)).max() < 1e-6


def test_centroid_searches():
    x = cloud(4000, 2).astype(np.float32)
    index = fit_centroids(x, 400)
    best, sims = index.search(x[:300], 4)
    assert (best[:, 0] == (x[:300] @ index.points.T).argmax(1)).all() and (np.diff(sims, axis=1) <= 0).all()
    found, _ = index.search(x[:300], 4, graph=True)
    assert (found[:, 0] == best[:, 0]).mean() > 0.9
    assert near_lists(best, sims, 1.1)[:, 0].all()
    assert Centroids(x[:1]).search(x[:3], 4)[0].shape == (3, 1)


@pytest.fixture(scope="module")
def rows():
    x = cloud(900, 3) * np.random.default_rng(0).uniform(0.1, 9, (900, 1))
    out = [(f"v{i:04d}", [float(v) for v in e], 1.5) for i, e in enumerate(x)]
    out += [(f"same{i:02d}", out[0][1], 2.5) for i in range(30)]  # equal vectors under other ids
    out += [out[5], out[5], (None, out[1][1], 0.0), ("null", None, 0.0), ("empty", [], 0.0), ("short", [1.0] * 5, 0.0), ("zero", [0.0] * DIM, 0.0), ("nan", [float("nan")] + [1.0] * (DIM - 1), 0.0)]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "id string, embedding array<float>, similarity double")
    pdf = pd.DataFrame([(r[0], None if r[1] is None else np.array(r[1], np.float32)) for r in rows], columns=["id", "embedding"])
    want = exact_most_similar(pdf, 5, DIM)
    got = {}
    for r in most_similar(df, 5, DIM, list_size=60).collect():
        got.setdefault(r.id, {})[r.other] = r.similarity
    assert set(got) == set(want) and not {"null", "empty", "short", "zero", "nan"} & set(got)
    hits = sum(len(set(got[i]) & {o for o, _ in near}) for i, near in want.items())
    assert hits / sum(len(n) for n in want.values()) > 0.9
    assert set(got["same07"]) == {o for o, _ in want["same07"]} == {"same00", "same01", "same02", "same03", "same04"}
    strong = {tuple(sorted((i, o))) for i, near in want.items() for o, s in near if s >= 0.9}
    pairs = [(r.id_a, r.id_b) for r in similar_pairs(most_similar(df, 5, DIM, 0.9, list_size=60)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= strong and len(set(pairs)) / len(strong) > 0.97


def as_sets(frame):
    got = {}
    for r in frame.collect():
        got.setdefault(r.id, set()).add(r.other)
    return got


def test_same_rows_without_broadcast_and_in_parts(spark, rows):
    df = spark.createDataFrame(rows, "id string, embedding array<float>, similarity double")
    plain = as_sets(most_similar(df, 5, DIM, list_size=60))
    assert as_sets(most_similar(df, 5, DIM, list_size=60, max_broadcast=0)) == plain
    assert as_sets(most_similar(df, 5, DIM, list_size=60, max_part=20)) == plain


def test_copies_of_one_row_are_a_third_of_all(spark):
    x = cloud(300, 8)
    rows = [(f"v{i:03d}", [float(v) for v in e]) for i, e in enumerate(x)] + [("v007", [float(v) for v in x[7]])] * 150 + [("twin", [float(v) * 2 for v in x[7]])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    got = as_sets(most_similar(df, 5, DIM, list_size=1000))
    pdf = pd.DataFrame({"id": [r[0] for r in dict(rows).items()], "embedding": [np.array(r[1], np.float32) for r in dict(rows).items()]})
    assert got == {i: {o for o, _ in near} for i, near in exact_most_similar(pdf, 5, DIM).items()}


def test_an_id_with_two_vectors_does_not_mix_classes(spark):
    x = cloud(60, 9)
    rows = [(f"v{i:02d}", [float(v) for v in e]) for i, e in enumerate(x)] + [("w", [float(v) for v in x[0]]), ("w", [float(v) for v in x[1]])]
    got = {(r.id, r.other): r.similarity for r in most_similar(spark.createDataFrame(rows, "id string, embedding array<float>"), 3, DIM, 0.999).collect()}
    assert {("v00", "w"), ("w", "v00"), ("v01", "w"), ("w", "v01")} == set(got)


def test_large_lists_are_balanced_again():
    x = cloud(3000, 10).astype(np.float32)
    ids = np.array([f"v{i:04d}" for i in range(len(x))], object)
    exact = {(int(r), int(c)) for rows, cols, _ in _blocks(ids, x, 5, -1.0) for r, c in zip(rows, cols)}
    s = x.astype(np.float64) @ x.T
    np.fill_diagonal(s, -9)
    brute = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -np.round(s, 6)), axis=1)[:, :5]
    assert len(exact & {(i, int(j)) for i, row in enumerate(brute) for j in row}) > 0.999 * len(exact)
    best = {}
    for rows, cols, sims in _nearest(ids, x, 5, -1.0, 400, 1.3, 3):
        for r, c, v in zip(rows, cols, sims):
            best.setdefault(int(r), {})[int(c)] = float(v)
    found = sum(len({c for c, _ in sorted(near.items(), key=lambda e: -e[1])[:5]} & {c for q, c in exact if q == r}) for r, near in list(best.items())[:300])
    assert found > 0.85 * 5 * 300
    same = np.repeat(x[:1], 500, 0)  # vectors that no centroid tells apart
    assert sum(len(r) for r, _, _ in _nearest(np.arange(500).astype(str).astype(object), same, 5, -1.0, 100, 1.3, 3)) == 2500


def test_search_for_stated_queries(spark, rows):
    df = spark.createDataFrame(rows, "id string, embedding array<float>, similarity double")
    asked = df.filter("id like '%7'")
    pdf = pd.DataFrame([(r[0], None if r[1] is None else np.array(r[1], np.float32)) for r in rows], columns=["id", "embedding"])
    want = exact_most_similar(pdf, 5, DIM)
    got = {}
    for r in search(asked, df, 5, DIM).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert set(got) == {i for i in want if i.endswith("7")}
    assert all(got[i] == {o for o, _ in want[i]} for i in got)
    assert search(asked, df, 5, DIM, block=20).count() == 5 * len(got)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, embedding array<float>")
    assert most_similar(df, 5, DIM).count() == 0 and search(df, df, 5, DIM).count() == 0
    one = spark.createDataFrame([("a", [1.0] * DIM)], "id string, embedding array<float>")
    assert most_similar(one, 5, DIM).count() == 0


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
@pytest.mark.parametrize("folder,least", [(oracle.FOLDER, 1.0), (oracle.FOLDER.replace("sf0.001", "sf0.01"), 0.95)])
def test_five_nearest_of_every_vector(spark, folder, least):
    want = exact_most_similar(spark.read.parquet(f"{folder}/vectors.parquet").toPandas(), 5)
    got = {}
    for r in catalog.queries()["p2_nearest"](spark, folder).collect():
        got.setdefault(r.id, {})[r.other] = r.similarity
    assert set(got) == set(want) and all(len(near) == 5 for near in got.values())
    pairs = [(i, other, s) for i, near in want.items() for other, s in near]
    found = [(got[i][other], s) for i, other, s in pairs if other in got[i]]
    assert len(found) >= least * len(pairs) and all(abs(a - b) < 2e-6 for a, b in found)
