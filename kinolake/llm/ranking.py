"""One global ranking from pairwise comparisons.

Rao-Kupper style model with ties and an order effect: with strengths ``s``, first-place
effect ``g`` and draw width ``d >= 0``

    P(first wins)  = 1 / (1 + exp(-(s_i - s_j + g - d)))
    P(second wins) = 1 / (1 + exp( (s_i - s_j + g + d)))

and the rest is a draw. Strengths, ``g`` and ``d`` come from a penalised Newton
optimisation on aggregated counts; the penalty (a normal prior on strengths) keeps
items that only ever won or lost finite.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.session import cut_lineage, spread

RANKED = "metric string, item string, strength double, std_error double, position int, n_comparisons bigint, order_effect double, draw_width double"


def aggregate_counts(votes: DataFrame, metric: str, first: str, second: str, outcome: str) -> DataFrame:
    """``metric, first, second, n_first, n_second, n_draw``; partial sums before the shuffle.

    ``outcome`` holds 1 (first won), 2 (second won) or 0 (draw); other rows, rows with a
    null and comparisons of an item with itself don't count.
    """
    usable = F.col(outcome).isin(0, 1, 2) & F.col(metric).isNotNull() & (F.col(first) != F.col(second))
    one = votes.filter(usable).select(F.col(metric).alias("metric"), F.col(first).alias("first"), F.col(second).alias("second"), F.col(outcome).alias("o"))
    counts = [F.sum((F.col("o") == k).cast("bigint")).alias(name) for k, name in ((1, "n_first"), (2, "n_second"), (0, "n_draw"))]
    return one.groupBy("metric", "first", "second").agg(*counts)


class _Design:
    """Margins ``s[first] - s[second] + g`` of all pairs, without a matrix of pairs by items."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n_items: int):
        self.first, self.second, self.n = first, second, n_items

    def times(self, x: np.ndarray) -> np.ndarray:
        return x[self.first] - x[self.second] + x[self.n]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed product: a value for each item, then one for the order effect."""
        return np.append(np.bincount(self.first, r, self.n) - np.bincount(self.second, r, self.n), r.sum())

    def diagonal(self, w: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.first, w, self.n) + np.bincount(self.second, w, self.n), w.sum())


def _uphill(curvature, grad: np.ndarray, diagonal: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """Conjugate gradients for ``curvature(step) = grad``; stops where the curvature isn't positive."""
    x, r = np.zeros_like(grad), grad.copy()
    z = r / diagonal
    d, rz = z.copy(), float(r @ z)
    end = tol * max(float(np.sqrt(grad @ grad)), 1e-30)
    for k in range(rounds):
        q = curvature(d)
        bend = float(d @ q)
        if bend <= 0:
            return x if k else z
        a = rz / bend
        x += a * d
        r -= a * q
        if np.sqrt(r @ r) <= end:
            break
        z = r / diagonal
        new = float(r @ z)
        d, rz = z + (new / rz) * d, new
    return x


def fit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, n_items: int, penalty: float = 0.05, steps: int = 60, tol: float = 1e-10, rounds: int = 400):
    """Strengths (mean 0), standard errors, order effect, draw width.

    ``counts`` has a row of (first wins, second wins, draws) for each (first, second).
    Without draws the width is 0 and is not fitted.

    Newton steps are solved by at most ``rounds`` conjugate gradients over the pairs, so
    time and memory follow the number of pairs that met, not items squared. Standard
    errors come from the diagonal of the curvature and its first correction by the
    opponents' (two terms of the series of the inverse), for strengths of mean 0: within
    a few percent where items met many others, too small where a few met only each other.
    """
    n1, n2, n0 = (counts[:, k].astype(float) for k in range(3))
    draws = bool(n0.sum() > 0)
    design = _Design(first, second, n_items)
    x = np.zeros(n_items + 2)  # strengths, order effect, log of the draw width
    x[-1] = np.log(max(0.05, n0.sum() / max(1.0, counts.sum()))) if draws else 0.0
    ridge = np.full(len(x), penalty)
    ridge[n_items] = ridge[-1] = 1e-6

    def parts(x):
        width = np.exp(x[-1]) if draws else 0.0
        m = design.times(x)
        p1, p2 = 1 / (1 + np.exp(-np.clip(m - width, -700, 700))), 1 / (1 + np.exp(np.clip(m + width, -700, 700)))
        return width, p1, p2, np.maximum(1 - p1 - p2, 1e-300)

    def value(x):
        _, p1, p2, p0 = parts(x)
        prior = x[-1] if draws else 0.0
        return (n1 * np.log(np.maximum(p1, 1e-300))).sum() + (n2 * np.log(np.maximum(p2, 1e-300))).sum() + (n0 * np.log(p0)).sum() * draws - 0.5 * (ridge[:-1] * x[:-1] ** 2).sum() - 0.5 * ridge[-1] * prior**2

    def derivatives(x):
        """Of the log-likelihood by margin and width: first, then second."""
        width, p1, p2, p0 = parts(x)
        v1, v2 = p1 * (1 - p1), p2 * (1 - p2)
        if not draws:
            none = np.zeros_like(p1)
            return width, n1 * (1 - p1) - n2 * (1 - p2), none, -(n1 + n2) * v1, none, none
        d0m, d0w = -v1 + v2, v1 + v2
        gm = n1 * (1 - p1) - n2 * (1 - p2) + n0 * d0m / p0
        gw = -n1 * (1 - p1) - n2 * (1 - p2) + n0 * d0w / p0
        a1, a2 = v1 * (1 - 2 * p1), v2 * (1 - 2 * p2)
        hmm = -n1 * v1 - n2 * v2 + n0 * ((-a1 - a2) / p0 - (d0m / p0) ** 2)
        hmw = n1 * v1 - n2 * v2 + n0 * ((a1 - a2) / p0 - d0m * d0w / p0**2)
        hww = -n1 * v1 - n2 * v2 + n0 * ((-a1 - a2) / p0 - (d0w / p0) ** 2)
        return width, gm, gw, hmm, hmw, hww

    best = value(x)
    for _ in range(steps):
        width, gm, gw, hmm, hmw, hww = derivatives(x)
        grad = np.append(design.back(gm), gw.sum() * width) - ridge * x
        of_width = -(hww.sum() * width**2 + gw.sum() * width) if draws else 1.0

        def curvature(d):
            t, dw = design.times(d), width * d[-1]
            return np.append(-design.back(hmm * t + hmw * dw), -width * (hmw * t).sum() + of_width * d[-1]) + ridge * d

        if not draws:
            grad[-1] = 0.0
        diagonal = np.maximum(np.append(-design.diagonal(hmm), of_width) + ridge, 1e-6)
        step = _uphill(curvature, grad, diagonal, rounds, 1e-9)
        scale = 1.0
        while scale > 1e-8 and value(x + scale * step) < best - 1e-12:
            scale /= 2
        x = x + scale * step
        now = value(x)
        done, best = abs(now - best) <= tol * (1 + abs(best)) and np.abs(scale * step).max() < 1e-8, now
        if done:
            break
    weight = -derivatives(x)[3]
    own = np.maximum(design.diagonal(weight)[:-1] + ridge[:n_items], 1e-12)
    # both orders of a pair are one off-diagonal entry
    key, at = np.unique(np.minimum(first, second).astype(np.int64) * n_items + np.maximum(first, second), return_inverse=True)
    a, b, shared = key // max(1, n_items), key % max(1, n_items), np.bincount(at.ravel(), weight, len(key)) if len(key) else np.zeros(0)
    correction = np.bincount(a, shared**2 / own[b], n_items) + np.bincount(b, shared**2 / own[a], n_items)
    errors = (1 - 1 / max(1, n_items)) * np.sqrt(1 / own + correction / own**2)
    return x[:n_items] - x[:n_items].mean(), errors, float(x[n_items]), float(np.exp(x[-1])) if draws else 0.0


def rank_items(counts: DataFrame, items: DataFrame | None = None, item: str = "item", penalty: float = 0.05, max_metrics: int = 10_000) -> DataFrame:
    """For each metric all items by descending strength, with standard errors.

    ``counts`` as from ``aggregate_counts``. ``items`` (one column ``item``) adds items
    that never met any other: they get strength near 0 with a wide error. Equal
    strengths are ordered by name. Metrics without counts do not appear; more than
    ``max_metrics`` of them are an error, not a truncation.

    One task fits one metric from one row for each two items that met, whatever the number
    of votes; the votes themselves never leave their partitions unaggregated.
    """
    counts = cut_lineage(counts)  # small; the votes are read once
    sides = counts.select("metric", F.col("first").alias("item")).union(counts.select("metric", F.col("second").alias("item"))).distinct()
    if items is not None:
        listed = items.select(F.col(item).cast("string").alias("item")).filter(F.col("item").isNotNull()).distinct()
        metrics = [r.metric for r in counts.select("metric").distinct().limit(max_metrics + 1).collect()]
        if len(metrics) > max_metrics:
            raise ValueError(f"more than max_metrics={max_metrics} metrics")
        named = listed.select(F.explode(F.array(*[F.lit(m) for m in sorted(metrics)]).cast("array<string>")).alias("metric"), "item")
        sides = sides.union(named).distinct()
    zero = F.lit(0).cast("bigint")
    alone = sides.select("metric", F.col("item").alias("first"), F.col("item").alias("second"), zero.alias("n_first"), zero.alias("n_second"), zero.alias("n_draw"))

    def one_metric(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["first"]) | set(pdf["second"]))
        at = {name: i for i, name in enumerate(names)}
        met = pdf[pdf["first"] != pdf["second"]].sort_values(["first", "second"])
        a, b = met["first"].map(at).to_numpy(int), met["second"].map(at).to_numpy(int)
        n = met[["n_first", "n_second", "n_draw"]].to_numpy()
        strengths, errors, order, width = fit(a, b, n, len(names), penalty)
        total = np.bincount(a, n.sum(1), len(names)) + np.bincount(b, n.sum(1), len(names))
        rank = np.empty(len(names), int)
        rank[sorted(range(len(names)), key=lambda i: (-strengths[i], names[i]))] = np.arange(1, len(names) + 1)
        return pd.DataFrame({"metric": pdf["metric"].iloc[0], "item": names, "strength": strengths, "std_error": errors, "position": rank.astype("int32"), "n_comparisons": total.astype("int64"), "order_effect": order, "draw_width": width})

    return spread(counts.unionByName(alone), "metric").groupBy("metric").applyInPandas(one_metric, RANKED)


def latest_votes(votes: DataFrame, draws: tuple[str, ...] = ()) -> DataFrame:
    """``custom_id, run, metric, outcome``: one row for each vote, by its latest judgement.

    Equal times: Answer 2 before Answer 1 before a draw before a winner that names none,
    so that the result doesn't depend on the order of the rows; a null time is before all
    others. Time and outcome are packed into one number, so that the maximum is combined
    in a hash table before the shuffle and no text is carried along.
    """
    outcome = outcome_of(F.col("winner"), draws)
    time = F.coalesce(F.unix_micros(F.col("judged_at").cast("timestamp")), F.lit(-(1 << 60)))
    packed = time * 4 + F.coalesce(outcome, F.lit(-1)) + 1
    last = votes.groupBy("custom_id", "run", "metric").agg(F.max(packed).alias("_last"))
    code = F.pmod("_last", F.lit(4)).cast("int") - 1
    return last.select("custom_id", "run", "metric", F.when(code >= 0, code).alias("outcome"))


def outcome_of(winner: Column, draws: tuple[str, ...] = ()) -> Column:
    """1 or 2 where the text names Answer 1 or Answer 2 apart from case, spaces and a final full stop; 0 for ``draws``; else null."""
    text = F.regexp_replace(F.lower(winner), "\\s+", "")
    text = F.regexp_replace(text, "\\.$", "")
    out = F.when(text == "answer1", 1).when(text == "answer2", 2)
    return out.when(text.isin(*draws), 0) if draws else out


def votes_to_outcomes(votes: DataFrame, draws: tuple[str, ...] = ()) -> DataFrame:
    """``metric, first, second, outcome`` of the latest judgements; the two methods come from the custom_id."""
    parts = F.split("custom_id", "\\+\\+")
    return latest_votes(votes, draws).select("metric", F.get(parts, F.lit(2)).alias("first"), F.get(parts, F.lit(3)).alias("second"), "outcome")


def top_items(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest items of each metric."""
    return ranked.filter(F.col("position") <= k)


def order_share(votes: DataFrame) -> DataFrame:
    """How often each place won, by metric."""
    outcomes = votes_to_outcomes(votes).filter(F.col("outcome").isNotNull())
    w = Window.partitionBy("metric")
    return outcomes.groupBy("metric", "outcome").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))
