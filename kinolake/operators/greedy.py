"""Greedy filling in order ("append while it fits, else start anew"), without one task per group.

The rule is sequential: where a bin starts depends on all bins before. Each block of
consecutive rows is therefore summarised as a function from "how full is the bin at the
block's start" to "how full at its end, and how many bins were started", which needs only
the places where the first overflow can happen. Summaries are composed in order, and since
that is associative, in a tree: up to a fan of neighbours at a time, so that no task sees
more than a fan of them however large a group is. Going down again, every node hands the
state at its start to its children; then every block numbers its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.operators.tables import global_rank
from kinolake.session import cut_lineage


def next_start(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For a bin starting at each row, the row that doesn't fit any more (the length if all fit). A row always fits into an empty bin."""
    run = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    nxt = np.searchsorted(run, run[:-1] + limit, side="right") - 1
    return np.maximum(np.minimum(nxt, n), np.arange(1, n + 1)) if n else np.zeros(0, np.int64)


def summarise(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each possible first overflow: the size before it, the fill at the end, the bins started. The last entry is "no overflow"."""
    n = len(sizes)
    run = np.concatenate([[0], np.cumsum(sizes)])
    nxt = next_start(sizes, limit)
    fill, bins = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if nxt[i] >= n:
            fill[i], bins[i] = run[n] - run[i], 1
        else:
            fill[i], bins[i] = fill[nxt[i]], bins[nxt[i]] + 1
    last = min(n, int(np.searchsorted(run[1:], limit, side="right")) + 1)  # overflows after a whole bin can't be the first
    return run[1 : last + 1], np.append(fill[:last], run[n]), np.append(bins[:last], 0)


def enter(before: np.ndarray, ends: np.ndarray, counts: np.ndarray, limit: int, fill: int, bins: int) -> tuple[int, int]:
    """State after a block that is entered with ``fill`` in the open one of ``bins`` bins (none is open where there is none)."""
    at = 0 if bins == 0 else int(np.searchsorted(before, limit - fill, side="right"))
    if at < len(before):
        return int(ends[at]), bins + int(counts[at])
    return fill + int(ends[-1]), bins


def chain(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summary of neighbouring blocks as one.

    A first overflow in a later block needs an entry fill that passes all blocks before it.
    Nothing passes once they hold more than the limit, so the summary stays short.
    """
    before, fill, bins, passed = [], [], [], 0
    for k, (edge, ends, counts) in enumerate(parts):
        over = np.flatnonzero(passed + edge > limit)
        m = int(over[0]) + 1 if len(over) else len(edge)
        f, b = ends[:m].copy(), counts[:m].copy()
        for later_edge, later_ends, later_counts in parts[k + 1 :]:
            at = np.searchsorted(later_edge, limit - f, side="right")
            first = at < len(later_edge)
            f, b = np.where(first, later_ends[at], f + later_ends[-1]), b + later_counts[at]  # the last count is 0
        before.append(passed + edge[:m])
        fill.append(f)
        bins.append(b)
        if len(over):
            break
        passed += int(ends[-1])
    total = sum(int(p[1][-1]) for p in parts)
    return np.concatenate(before), np.append(np.concatenate(fill), total), np.append(np.concatenate(bins), 0)


def walk(sizes: np.ndarray, limit: int, fill: int, bins: int) -> np.ndarray:
    """Number of the bin of every row; ``fill`` and ``bins`` say what is open before the first."""
    n = len(sizes)
    run = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(n, np.int64)
    at = 0
    if bins > 0:
        at = min(n, int(np.searchsorted(run, limit - fill, side="right")) - 1) if fill <= limit else 0
        out[:at] = bins - 1
    nxt = next_start(sizes, limit)
    while at < n:
        out[at : nxt[at]] = bins
        bins += 1
        at = nxt[at]
    return out


_SUMMARY = "_g string, _block bigint, before array<bigint>, fill array<bigint>, bins array<bigint>"
_ENTRY = "_g string, _block bigint, _fill bigint, _bins bigint"


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(r.before, np.int64), np.asarray(r.fill, np.int64), np.asarray(r.bins, np.int64)


def _entries(summaries: DataFrame, limit: int, fan: int, blocks: int) -> DataFrame:
    """``_g, _block, _fill, _bins``: the state at each block's start; no group has more than about ``blocks`` of them."""

    def states(pdf: pd.DataFrame, fill: int, bins: int) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("_block").itertuples(index=False):
            rows.append((r[0], r[1], fill, bins))
            fill, bins = enter(*_arrays(r), limit, fill, bins)
        return pd.DataFrame(rows, columns=["_g", "_block", "_fill", "_bins"])

    names = ["_g", "_block", "before", "fill", "bins"]
    if blocks <= fan:
        return summaries.groupBy("_g").applyInPandas(lambda pdf: states(pdf[names], 0, 0), _ENTRY)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        before, fill, bins = chain([_arrays(r) for r in pdf.sort_values("_block").itertuples(index=False)], limit)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_block": [int(pdf["_block"].iloc[0]) // fan], "before": [before], "fill": [fill], "bins": [bins]})

    summaries = cut_lineage(summaries)  # read going up and going down
    up = cut_lineage(summaries.groupBy("_g", F.floor(F.col("_block") / fan)).applyInPandas(lambda pdf: join(pdf[names]), _SUMMARY))
    above = _entries(up, limit, fan, blocks // fan + 2).withColumnRenamed("_block", "_up")
    under = summaries.withColumn("_up", F.floor(F.col("_block") / fan)).join(above, ["_g", "_up"])
    return under.groupBy("_g", "_up").applyInPandas(lambda pdf: states(pdf[names], int(pdf["_fill"].iloc[0]), int(pdf["_bins"].iloc[0])), _ENTRY)


def greedy_bins(items: DataFrame, group: list[str], order: list[str], size: str, limit: int, block: int = 4096, fan: int = 512, out: str = "bin") -> DataFrame:
    """Adds the number of the bin (from 0 within the group) to every row.

    Rows are taken in ``order`` (made total by the caller, nulls first); a row joins the
    open bin if the sizes stay within ``limit``, else it opens the next. A row over the
    limit is a bin of its own (bound sizes before for another rule). Null sizes count as
    0; null groups are a group.

    Rows are numbered by a range sort over groups and order, so neither a large group nor
    crowded order values make a large task; blocks of ``block`` rows are summarised in
    parallel and their summaries composed ``fan`` at a time. The numbered rows are written
    once to the checkpoint folder, so pass narrow rows and join the rest back.
    """
    taken = [out, "_g", "_block", "_at", "_size"]
    if any(c in items.columns for c in taken):
        raise ValueError("the items have a column named like one that is added")
    if fan < 3:
        raise ValueError("fan must be at least 3")
    sized = items.withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)))
    keyed = sized.withColumn("_g", F.to_json(F.struct(*group)))  # the key is never null, also for null groups
    numbered = global_rank(keyed, [F.col("_g"), *[F.col(c).asc_nulls_first() for c in order]], "_at")
    numbered = numbered.withColumn("_block", F.floor(F.col("_at") / block).cast("bigint"))
    narrow = numbered.select("_g", "_block", "_at", "_size")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("_at")["_size"].to_numpy(np.int64)
        before, fill, bins = summarise(sizes, limit)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_block": [pdf["_block"].iloc[0]], "before": [before], "fill": [fill], "bins": [bins]})

    summaries = narrow.groupBy("_g", "_block").applyInPandas(summary, _SUMMARY)
    opened = narrow.join(_entries(summaries, limit, fan, numbered.count() // block + 2), ["_g", "_block"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        bins = walk(pdf["_size"].to_numpy(np.int64), limit, int(pdf["_fill"].iloc[0]), int(pdf["_bins"].iloc[0]))
        return pd.DataFrame({"_at": pdf["_at"].to_numpy(), out: bins})

    bins = opened.groupBy("_g", "_block").applyInPandas(number, f"_at bigint, `{out}` int")
    return numbered.join(bins, "_at").select(*items.columns, out)
