import numpy as np

from kinolake.llm.ranking import aggregate_counts, fit, latest_votes, outcome_of, rank_items, votes_to_outcomes


def simulate(rng, strengths, n, order, width, hot=0.5):
    k = len(strengths)
    a = np.where(rng.random(n) < hot, 0, rng.integers(0, k, n))
    b = rng.integers(0, k, n)
    a, b = a[a != b], b[a != b]
    flip = rng.random(len(a)) < 0.5
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    m = strengths[a] - strengths[b] + order
    u = rng.random(len(a))
    p1, p2 = 1 / (1 + np.exp(-(m - width))), 1 / (1 + np.exp(m + width))
    return a, b, np.where(u < p1, 0, np.where(u < p1 + p2, 1, 2))


def table(a, b, o):
    keys, at = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)
    counts = np.zeros((len(keys), 3))
    np.add.at(counts, (at.ravel(), o), 1)
    return keys[:, 0], keys[:, 1], counts


def test_recovers_parameters():
    rng = np.random.default_rng(1)
    truth = np.linspace(-1, 1, 8)
    s, err, g, d = fit(*table(*simulate(rng, truth, 60000, 0.3, 0.2)), 8)
    assert np.abs(s - truth).max() < 0.1 and abs(g - 0.3) < 0.05 and abs(d - 0.2) < 0.05 and (err < 0.1).all()
    s, _, g, d = fit(*table(*simulate(rng, truth, 60000, -0.2, 0.0)), 8)
    assert np.abs(s - truth).max() < 0.1 and abs(g + 0.2) < 0.05 and d == 0


def test_gradient_is_zero_at_the_optimum():
    rng = np.random.default_rng(2)
    a, b, n = table(*simulate(rng, np.array([0.5, 0.0, -0.5]), 400, 0.1, 0.0))
    s, _, g, _ = fit(a, b, n, 3, penalty=0.05)

    def value(x):
        m = x[a] - x[b] + x[3]
        return -(n[:, 0] * np.log1p(np.exp(-m))).sum() - (n[:, 1] * np.log1p(np.exp(m))).sum() - 0.025 * (x[:3] ** 2).sum()

    x = np.append(s, g)
    for i in range(4):
        e = np.eye(4)[i] * 1e-4
        assert value(x) >= value(x + e) - 1e-6 and value(x) >= value(x - e) - 1e-6


def test_against_a_dense_solution():
    """Strengths at a zero gradient of the dense form; errors close to those of the inverted curvature."""
    rng = np.random.default_rng(3)
    truth = rng.normal(size=12)
    a, b, n = table(*simulate(rng, truth, 9000, 0.2, 0.0))
    s, err, g, _ = fit(a, b, n, 12)
    p = 1 / (1 + np.exp(-(s[a] - s[b] + g)))
    w = (n[:, 0] + n[:, 1]) * p * (1 - p)
    h = np.zeros((13, 13))
    for i, j, v in zip(a, b, w):
        d = np.zeros(13)
        d[i], d[j], d[12] = 1, -1, 1
        h += v * np.outer(d, d)
    h += np.diag([0.05] * 12 + [1e-6])
    center = np.eye(12) - 1 / 12
    want = np.sqrt(np.diag(center @ np.linalg.inv(h)[:12, :12] @ center))
    assert np.abs(err / want - 1).max() < 0.15
    r = n[:, 0] * (1 - p) - n[:, 1] * p
    # strengths are reported with mean 0, which the penalty alone would also give
    assert np.abs(np.bincount(a, r, 12) - np.bincount(b, r, 12) - 0.05 * s).max() < 1e-4


def test_many_items():
    rng = np.random.default_rng(4)
    n = 10_000
    truth = rng.normal(size=n)
    a, b = rng.integers(0, n, 300_000), rng.integers(0, n, 300_000)
    a, b = a[a != b], b[a != b]
    won = rng.random(len(a)) < 1 / (1 + np.exp(-(truth[a] - truth[b] + 0.3)))
    s, err, g, _ = fit(a, b, np.stack([won, ~won, np.zeros(len(a))], 1), n)
    assert np.corrcoef(s, truth)[0, 1] > 0.93 and abs(g - 0.3) < 0.03 and np.isfinite(err).all()


def test_latest_votes(spark):
    cid = "1-x++query1++A++B++ori"
    rows = [(cid, 1, "m", "Answer 1", "2025-01-01 00:00:01"), (cid, 1, "m", "none", "2025-01-01 00:00:02"), (cid, 2, "m", "answer 1", "2025-01-01 00:00:02"), (cid, 2, "m", "Answer 2", "2025-01-01 00:00:02"), (cid, 3, "m", "Answer 1", None)]
    got = {r.run: r.outcome for r in latest_votes(spark.createDataFrame(rows, "custom_id string, run int, metric string, winner string, judged_at string")).collect()}
    assert got == {1: None, 2: 2, 3: 1}


def test_one_sided_items_stay_finite():
    s, err, _, _ = fit(np.array([0]), np.array([1]), np.array([[5, 0, 0]]), 3)
    assert np.isfinite(s).all() and np.isfinite(err).all() and s[0] > s[2] > s[1]


def test_frame(spark):
    t = lambda s: f"2025-01-01 00:00:0{s}"
    cid = lambda a, b: f"1-x++query1++{a}++{b}++ori"
    rows = [
        (cid("A", "B"), "Depth", "Answer 1", 1, t(1), "e"), (cid("A", "B"), "Depth", "Answer 1", 1, t(1), "e"),  # a copy
        (cid("B", "C"), "Depth", " ANSWER  1. ", 1, t(1), "e"), (cid("A", "C"), "Depth", "Answer 2", 1, t(1), "e"),
        (cid("A", "C"), "Depth", "answer 1", 1, t(2), None), (cid("C", "A"), "Depth", None, 1, t(1), None),
        (cid("C", "A"), "Depth", "Both", 2, t(1), None), ("broken", "Depth", "Answer 1", 1, t(1), None), (None, None, None, None, None, None),
    ]
    votes = spark.createDataFrame(rows, "custom_id string, metric string, winner string, run int, judged_at string, explanation string")
    counts = aggregate_counts(votes_to_outcomes(votes), "metric", "first", "second", "outcome")
    got = {(r["first"], r["second"]): (r.n_first, r.n_second, r.n_draw) for r in counts.collect()}
    assert got == {("A", "B"): (1, 0, 0), ("B", "C"): (1, 0, 0), ("A", "C"): (1, 0, 0)}
    items = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("D",), (None,)], "method string")
    ranked = {r.item: r for r in rank_items(counts, items, "method").collect()}
    assert set(ranked) == set("ABCD") and ranked["A"].position == 1 and ranked["C"].position == 4
    assert abs(sum(r.strength for r in ranked.values())) < 1e-9
    assert rank_items(counts.limit(0), items, "method").count() == 0
    draws = votes_to_outcomes(votes, ("both",)).filter("outcome = 0").count()
    assert draws == 1
    texts = spark.createDataFrame([("Answer 3",), ("",), ("N/A",), ("Answer 1 and Answer 2",)], "w string")
    assert texts.filter(outcome_of(texts.w).isNotNull()).count() == 0
