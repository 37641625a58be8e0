"""Filling fixed-capacity containers with whole items: a linear grouping scheme.

Per group (a video) only the histogram of lengths is gathered, at most ``capacity`` + 1
rows however many items there are. On it

1. large lengths are rounded up within groups of equal cardinality, so that few sizes remain;
2. the container configurations of these sizes are optimised by column generation
   (a linear program whose columns are found by a knapsack), and rounded down;
3. actual lengths are substituted into the configurations, which frees space;
4. what is left of the large items and then the small ones go best-fit, longest first.

The outcome is a table of ranges "items number a to b of this length go to containers
from c on, k in each", which the items look up by their number within (group, length).
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.session import cut_lineage, spread

_RANGES = "grp string, len int, start bigint, n bigint, container bigint, per int"


# ---------------------------------------------------------------- on one histogram


def group_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """For each length (descending) its rounded-up size; equal cardinality per group."""
    if len(lengths) <= groups:
        return lengths.copy()
    before = np.cumsum(counts) - counts
    of = before * groups // counts.sum()
    return np.array([lengths[of == g].max() for g in of])


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Multiplicities of the best configuration, by the number of items in it."""
    most = capacity // int(sizes.min())
    best, choice = np.zeros(capacity + 1), []
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    ok = at >= 0
    for _ in range(most):
        gain = np.where(ok, best[np.maximum(at, 0)] + values[:, None], -1.0)
        pick = gain.argmax(0)
        top = gain[pick, np.arange(capacity + 1)]
        take = top > best + 1e-12
        if not take.any():
            break
        choice.append(np.where(take, pick, -1))
        best = np.where(take, top, best)
    out, left = np.zeros(len(sizes), int), capacity
    for pick in reversed(choice):
        if pick[left] >= 0:
            out[pick[left]] += 1
            left -= int(sizes[pick[left]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 8) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, from the linear program's optimum rounded down."""
    k = len(sizes)
    basis = np.diag([max(1, capacity // int(s)) for s in sizes]).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds * k):
        dual = np.linalg.solve(basis.T, np.ones(k))
        new = _knapsack(sizes, np.maximum(dual, 0), capacity).astype(float)
        if new @ dual <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = new
        x = np.maximum(x, 0)
    return [(basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] + 1e-9 >= 1]


def _longest(ascending: list[int], have: dict[int, int], taken: Counter, most: int, least: int) -> int | None:
    """The greatest length in [least, most] of which an item is left."""
    i = bisect.bisect_right(ascending, most) - 1
    while i >= 0 and ascending[i] >= least:
        if have[ascending[i]] > taken[ascending[i]]:
            return ascending[i]
        i -= 1
    return None


class _Store:
    """Containers of equal content as classes ``(rest, first container, how many)``, kept by their rest."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.rests: list[int] = []

    def add(self, rest: int, first: int, n: int) -> None:
        if n <= 0:
            return
        if rest not in self.by:
            self.by[rest] = []
            bisect.insort(self.rests, rest)
        self.by[rest].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The class with the smallest rest that is at least ``least``."""
        i = bisect.bisect_left(self.rests, least)
        if i == len(self.rests):
            return None
        rest = self.rests[i]
        first, n = self.by[rest].pop()
        if not self.by[rest]:
            del self.by[rest]
            self.rests.pop(i)
        return rest, first, n


def pack_histogram(lengths: Sequence[int], counts: Sequence[int], capacity: int, groups: int = 40, large: float = 0.125) -> list[tuple[int, int, int, int, int]]:
    """``(length, start, n, container, per)``: items ``start``..``start + n - 1`` of the
    length go to ``container``, ``container + 1``, ... with ``per`` in each.

    Lengths are 0..capacity. Length 0 goes to container 0.
    """
    order = np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable")
    lens, cnt = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    out: list[tuple[int, int, int, int, int]] = []
    used = {int(v): 0 for v in lens}
    store, opened = _Store(), 0
    big = (lens > capacity * large) & (lens < capacity)
    if big.any():
        total = int(cnt[big].sum())
        sizes_of = group_sizes(lens[big], cnt[big], max(1, min(groups, total // 5)))
        sizes = np.unique(sizes_of)[::-1]
        demand = np.array([cnt[big][sizes_of == s].sum() for s in sizes], dtype=float)
        have = dict(zip(lens[big].tolist(), cnt[big].tolist()))
        ascending = sorted(have)
        low = {int(s): int(lens[big][sizes_of == s].min()) for s in sizes}
        for config, times in configurations(sizes, demand, capacity):
            slots = [int(s) for s, n in zip(sizes, config) for _ in range(n)]
            left = times
            while left > 0:
                # substitute actual lengths; the last slot, and what rounding up left free, takes the longest that still fits
                rest, picks = capacity, Counter()
                for k, size in enumerate(slots):
                    most, least = (size, low[size]) if k + 1 < len(slots) else (rest, 0)
                    value = _longest(ascending, have, picks, min(most, rest), least)
                    if value is None:
                        break
                    picks[value] += 1
                    rest -= value
                else:
                    while (value := _longest(ascending, have, picks, rest, 0)) is not None:
                        picks[value] += 1
                        rest -= value
                    run = min(left, *(have[v] // n for v, n in picks.items()))
                    for value, n in picks.items():
                        out.append((value, used[value], n * run, opened, n))
                        used[value] += n * run
                        have[value] -= n * run
                        if not have[value]:
                            ascending.pop(bisect.bisect_left(ascending, value))
                    store.add(rest, opened, run)
                    opened += run
                    left -= run
                    continue
                break  # fewer items than slots are left; they go best-fit
    for value, count in zip(lens.tolist(), cnt.tolist()):
        left = count - used[value]
        if value == 0:
            if left:
                out.append((0, 0, left, 0, left))
                opened = max(opened, 1)
            continue
        while left > 0:
            got = store.take(value)
            rest, first, n = got if got else (capacity, opened, -(-left // (capacity // value)))
            fit = rest // value
            if left >= fit:
                full = min(n, left // fit)
                out.append((value, used[value], full * fit, first, fit))
                moved, k = full * fit, fit
            else:
                full, moved, k = 1, left, left
                out.append((value, used[value], left, first, left))
            used[value] += moved
            left -= moved
            store.add(rest - k * value, first, full)
            if got:
                store.add(rest, first + full, n - full)
            else:
                opened += full
    return out


# ---------------------------------------------------------------- on frames


def pieces_of(items: DataFrame, item: str, group: str, length: str, capacity: int) -> DataFrame:
    """``grp, item, piece, len``: items over the capacity are divided into full pieces and a rest."""
    n = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    one = items.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), n.alias("_n"))
    last = F.when(F.col("_n") <= capacity, F.lit(0).cast("bigint")).otherwise(F.expr(f"(_n - 1) div {capacity}"))
    cut = one.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rest = F.when(F.col("piece") < last, F.lit(capacity).cast("bigint")).otherwise(F.col("_n") - F.col("piece") * capacity)
    return cut.select("grp", "item", F.col("piece").cast("int").alias("piece"), rest.cast("int").alias("len"))


def pack_items(
    items: DataFrame, item: str, group: str, length: str, capacity: int = 1200, groups: int = 40, salts: int = 64
) -> DataFrame:
    """``grp, item, piece, len, container, fill``: the container of every item or piece.

    Containers are numbered from 0 within a group and are never shared between groups;
    ``fill`` is the total length in the container. Items longer than the capacity, and
    only these, are divided (``piece`` > 0 exists). Null or negative lengths count as 0;
    empty items go to container 0. A null group is a group of its own (``grp`` null).
    Rows that agree in item, group and length are copies and are packed once; other
    columns of ``items`` are not carried.

    Histograms are pre-aggregated. An item's number within (group, length) is found in
    ``salts`` parts, so a group with a third of all rows is spread over tasks; the lookup
    joins on the same salted key.
    """
    parts = pieces_of(items.select(group, item, length).distinct(), item, group, length, capacity)
    parts = cut_lineage(parts.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.lit(salts)).cast("int")))  # narrow; texts are read once
    by_salt = parts.groupBy("grp", "len", "salt").agg(F.count("*").alias("n"))
    histogram = by_salt.groupBy("grp", "len").agg(F.sum("n").alias("n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pack_histogram(pdf["len"].tolist(), pdf["n"].tolist(), capacity, groups)
        out = pd.DataFrame(rows, columns=["len", "start", "n", "container", "per"])
        out.insert(0, "grp", pdf["grp"].iloc[0])
        return out.astype({"len": "int32", "per": "int32"})

    ranges = spread(histogram, "grp").groupBy("grp").applyInPandas(pack, _RANGES)
    ranges = ranges.groupBy("grp", "len").agg(F.array_sort(F.collect_list(F.struct("start", "n", "container", "per"))).alias("ranges"))
    before = Window.partitionBy("grp", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    lookup = offsets.join(ranges, same(offsets, ranges, "grp", "len")).select(
        offsets["grp"].alias("g"), offsets["len"].alias("l"), offsets["salt"].alias("s"), "offset",
        F.filter("ranges", lambda r: (r["start"] < F.col("offset") + F.col("n")) & (r["start"] + r["n"] > F.col("offset"))).alias("ranges"),
    )
    number = F.row_number().over(Window.partitionBy("grp", "len", "salt").orderBy("item", "piece")) - 1
    numbered = parts.withColumn("_at", number)
    joined = numbered.join(lookup, numbered["grp"].eqNullSafe(lookup["g"]) & (numbered["len"] == lookup["l"]) & (numbered["salt"] == lookup["s"]))
    at = F.col("_at") + F.col("offset")
    hit = F.get(F.filter("ranges", lambda r: (r["start"] <= at) & (r["start"] + r["n"] > at)), F.lit(0))
    placed = joined.withColumn("_hit", hit).withColumn("_num", at)
    placed = placed.select("grp", "item", "piece", "len", F.expr("_hit.container + (_num - _hit.start) div _hit.per").alias("container"))
    # all empty items of a group are in container 0, however many: they look its fill up in salted parts
    fills = placed.groupBy("grp", "container").agg(F.sum("len").alias("fill"))
    part = F.explode(F.when(F.col("container") == 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    fills = fills.select(F.col("grp").alias("g"), F.col("container").alias("c"), "fill", part.alias("s"))
    placed = placed.withColumn("s_", F.when(F.col("container") == 0, F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    same = placed["grp"].eqNullSafe(fills["g"]) & (placed["container"] == fills["c"]) & (placed["s_"] == fills["s"])
    return placed.join(fills, same).select("grp", "item", "piece", "len", "container", "fill")


def container_fill(packed: DataFrame, capacity: int = 1200) -> DataFrame:
    """``grp, container, n_items, fill, share``."""
    one = packed.groupBy("grp", "container").agg(F.count("*").alias("n_items"), F.sum("len").alias("fill"))
    return one.withColumn("share", F.col("fill") / F.lit(float(capacity)))
