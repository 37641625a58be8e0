"""Chunking of segments and texts, token budgets, request batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import ids
from kinolake.functions.text import strip
from kinolake.functions.tokens import first_tokens, token_count, tokens
from kinolake.operators.greedy import greedy_bins
from kinolake.operators.tables import last_by_key, only_new

#: Separators of the separator chunker, strongest first (ours).
SEPARATORS = ("\n\n", "\r\n", "\n", "。", "！", "？", ". ", "! ", "? ", ".\t", "!\t", "?\t")


def fixed_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, overlap: int = 128) -> DataFrame:
    """``doc_id, chunk_order_index, tokens, content``: windows of ``size`` tokens every ``size - overlap`` tokens.

    Tokens are joined by single spaces. Null and blank texts give no chunk.
    """
    one = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("_t")).filter(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.size("_t") - 1, F.lit(size - overlap))
    one = one.select("doc_id", "_t", F.posexplode(starts).alias("chunk_order_index", "_s"))
    part = F.slice("_t", F.col("_s") + 1, F.lit(size))
    return one.select("doc_id", "chunk_order_index", F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))


def packed_chunks(segments: DataFrame, limit: int = 1200, video: str = "video_name", index: str = "segment_index", segment: str = "segment_id", content: str = "content") -> DataFrame:
    """``video_name, chunk_order_index, tokens, content, video_segment_id``: whole segments in order while they fit.

    A segment over the limit is cut to its first tokens; null content is empty. Copied
    rows count once; segments of one index are ordered by id. A video without any token
    gives no chunk. Only sizes and hashes take part in the packing (see ``greedy_bins``);
    texts are moved twice, to their place and to their chunk, which the limit bounds.
    """
    rows = segments.select(F.col(video).alias("video_name"), F.col(index).cast("int").alias("segment_index"), F.col(segment).alias("segment_id"), F.col(content).alias("content"))
    key = ["video_name", "segment_index", "segment_id", "_h"]
    rows = rows.withColumn("_h", F.coalesce(F.md5("content"), F.lit("")))
    sizes = rows.select(*key, F.least(token_count("content"), F.lit(limit)).alias("n")).distinct()
    placed = greedy_bins(sizes, ["video_name"], ["segment_index", "segment_id", "_h"], "n", limit, out="chunk_order_index")
    placed = placed.select(*[F.col(c).alias("_k" + c) for c in key], "n", "chunk_order_index")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col("_k" + c))
    cut = rows.join(placed, same).withColumn("_text", first_tokens("content", token_count("content"), limit))
    # copies of a segment fall together in the set
    parts = F.array_sort(F.collect_set(F.struct("segment_index", "segment_id", "_h", "n", "_text")))
    out = cut.groupBy("video_name", "chunk_order_index").agg(parts.alias("_p"))
    total = F.aggregate("_p", F.lit(0), lambda t, p: t + p["n"])
    made = out.select("video_name", "chunk_order_index", total.alias("tokens"), strip(F.array_join(F.transform("_p", lambda p: p["_text"]), "")).alias("content"), F.transform("_p", lambda p: p["segment_id"]).alias("video_segment_id"))
    return made.filter(F.col("tokens") > 0)


def dedup_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``chunk_id`` from the content and keeps the last chunk of each id in ``order``."""
    return last_by_key(chunks.withColumn("chunk_id", ids.chunk_id("content")), "chunk_id", order)


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks that aren't stored yet."""
    return only_new(chunks, known, "chunk_id")


# ---------------------------------------------------------------- separator chunker

_LOSSLESS = re.compile(r"[^ \t\n\r]+[ \t\n\r]*|^[ \t\n\r]+")


def split_at_separators(text: str, separators: tuple[str, ...] = SEPARATORS) -> list[list[str]]:
    """Runs of tokens that end with a separator (kept at the end); tokens keep the white space after them."""
    pattern = re.compile("|".join(re.escape(s) for s in separators))
    out, start = [], 0
    for m in pattern.finditer(text):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [run for run in (_LOSSLESS.findall(part) for part in out) if run]


def merge_runs(runs: list[list[str]], size: int) -> list[list[str]]:
    """Neighbouring runs joined while they fit; a run over the size stays whole."""
    out: list[list[str]] = []
    for run in runs:
        if out and len(out[-1]) + len(run) <= size:
            out[-1] = out[-1] + run
        else:
            out.append(run)
    return out


def separator_pieces(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[list[str]]:
    """Pieces of one text: merged runs with the tail of the one before in front, cut to the size.

    If everything is one run over the size it is cut into windows, of which those not
    longer than the overlap are dropped.
    """
    merged = merge_runs(split_at_separators(text or "", separators), size)
    if len(merged) == 1 and len(merged[0]) > size:
        windows = [merged[0][i : i + size] for i in range(0, len(merged[0]), size - overlap)]
        return [w for w in windows if len(w) > overlap]
    if overlap <= 0:
        return merged
    return [run if not i else (merged[i - 1][-overlap:] + run)[:size] if len(merged[i - 1][-overlap:]) + len(run) > size else merged[i - 1][-overlap:] + run for i, run in enumerate(merged)]


def separator_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, overlap: int = 128, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """``doc_id, chunk_order_index, tokens, content``; null and empty texts give no chunk."""

    @F.pandas_udf("array<struct<tokens: int, content: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[(len(p), "".join(p).strip()) for p in separator_pieces(t, size, overlap, separators)] for t in texts], dtype=object)

    one = docs.select(F.col(doc_id).alias("doc_id"), cut(F.col(text)).alias("_c")).select("doc_id", F.posexplode("_c").alias("chunk_order_index", "_p"))
    return one.select("doc_id", "chunk_order_index", F.col("_p.tokens").alias("tokens"), F.col("_p.content").alias("content"))


# ---------------------------------------------------------------- budgets


def budget_prefix(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Of each group the longest prefix in ``order`` whose sizes sum to at most ``budget``; nothing for a budget of 0 or less.

    A ranked list per question is short; use it for such groups (one group is one task).
    """
    if budget <= 0:
        return rows.limit(0)
    run = F.sum(F.coalesce(F.col(size), F.lit(0)).cast("bigint")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).filter(F.col("_run") <= budget).drop("_run")


def batch_requests(requests: DataFrame, group: list[str], order: list[str], size: str, budget: int, out: str = "batch") -> DataFrame:
    """Requests in order into batches of at most ``budget`` tokens; a request over the budget is a batch of its own."""
    return greedy_bins(requests, group, order, size, budget, out=out)
