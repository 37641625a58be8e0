"""Splitting oversized items at natural boundaries, with an overlap between pieces.

Balanced targets: the minimum piece count gives equal-length targets, each target is
snapped to the strongest boundary nearby, and pieces are added when a limit fails.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.functions.tokens import token_count, token_spans

#: Ranks of what ends with a token.
SENTENCE, LINE, PARAGRAPH = 1, 2, 3
_SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)\\]]*$")

PIECES = "array<struct<piece int, content string, tokens int, char_start bigint, char_end bigint, boundary int>>"


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each token the rank of the boundary at its end; 0 where there is none."""
    ranks = [0] * len(spans)
    for i in range(len(spans) - 1):
        gap = text[spans[i][1] : spans[i + 1][0]]
        breaks = gap.count("\n") or gap.count("\r")
        if breaks > 1:
            ranks[i] = PARAGRAPH
        elif breaks:
            ranks[i] = LINE
        elif _SENTENCE_END.search(text, max(spans[i][0], spans[i][1] - 8), spans[i][1]):
            ranks[i] = SENTENCE
    return ranks


def cut_points(ranks: list[int], limit: int, overlap: int) -> list[int]:
    """Ends of the pieces in tokens, the last being the number of tokens.

    Every piece has at most ``limit`` tokens with the ``overlap`` it repeats. A cut
    falls on a boundary wherever one lies within reach of the piece; only a piece
    without any is cut at its target.
    """
    n, step = len(ranks), limit - overlap
    where = {r: [i + 1 for i in range(n - 1) if ranks[i] >= r] for r in (PARAGRAPH, LINE, SENTENCE)}
    ends, start = [], 0
    pieces = max(1, -(-(n - overlap) // step))  # the minimum that can hold everything
    while True:
        first = not ends
        reach = start + (limit if first else step)
        if reach >= n:
            return [*ends, n]
        left = max(pieces - len(ends), -(-(n - start - (overlap if first else 0)) // step), 2)
        share = (n - start - (overlap if first else 0)) / left + (overlap if first else 0)
        target = min(reach, start + max(1, round(share)))
        lowest = max(start + 1, n - (left - 1) * step)
        least = max(lowest, start + overlap + 1) if overlap + 1 + start <= reach else lowest
        cut = _snap(where, target, least, reach, max(1, round(share / 4)))
        if cut is None:  # a limit fails: no boundary keeps the piece count, so a piece is added
            cut = _snap(where, target, max(start + 1, min(start + overlap + 1, reach)), reach, reach)
        ends.append(cut if cut is not None else target)
        start = ends[-1]


def _snap(where: dict[int, list[int]], target: int, low: int, high: int, near: int) -> int | None:
    """The strongest boundary within ``near`` of the target, else the nearest of any rank in [low, high]."""
    for reach in (near, high):
        lo, hi = max(low, target - reach), min(high, target + reach)
        for rank in (PARAGRAPH, LINE, SENTENCE):
            at = where[rank]
            a, b = bisect_left(at, lo), bisect_right(at, hi)
            if a < b:
                i = bisect_left(at, target, a, b)
                return min((at[j] for j in (i - 1, i) if a <= j < b), key=lambda x: (abs(x - target), x))
    return None


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, str, int, int, int, int]]:
    """``(piece, content, tokens, char_start, char_end, boundary)`` of one text.

    A piece takes the white space up to its end, so the pieces without what they repeat
    give the text back character by character.
    """
    spans = token_spans(text)
    ranks = boundaries(text, spans)
    out, start = [], 0
    for k, end in enumerate(cut_points(ranks, limit, overlap)):
        first = max(0, start - overlap) if k else 0
        a = spans[first][0] if first else 0
        b = spans[end][0] if end < len(spans) else len(text)
        out.append((k, text[a:b], end - first, a, b, ranks[end - 1] if end < len(spans) else PARAGRAPH))
        start = end
    return out


def split_items(
    items: DataFrame, content: str = "content", limit: int = 1024, overlap: int = 128, order: str = "chunk_order_index"
) -> DataFrame:
    """Replaces every row whose content has more than ``limit`` tokens by its pieces.

    Returns the columns of ``items`` with ``content`` and ``tokens`` of the piece, the
    piece number in ``order`` (pieces are numbered from 0; an untouched row keeps its
    number), and ``n_pieces``, ``char_start``, ``char_end``, ``boundary`` (3 paragraph,
    2 line, 1 sentence, 0 none; null for untouched rows). Columns of these names in
    ``items`` are replaced. Null content has 0 tokens and stays as it is. Copied rows
    are returned as often as they come in; see ``distinct_rows``.

    One scan and no shuffle: only oversized texts cross to Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")

    @F.pandas_udf(PIECES)
    def cut_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, limit, overlap) for t in texts], dtype=object)

    pieces = cut_texts.asNondeterministic()  # else a filter on the pieces would have every text cut a second time

    added = ("tokens", order, "n_pieces", "char_start", "char_end", "boundary")
    kept = [c for c in items.columns if c not in (content, *added)]
    own_order = F.col(order) if order in items.columns else F.lit(None).cast("int")
    one = items.select(*kept, F.col(content).alias("_text"), own_order.cast("int").alias("_order"), token_count(content).alias("_n"))
    cut = one.withColumn("_pieces", pieces(F.when(F.col("_n") > limit, F.col("_text"))))
    whole = F.array(
        F.struct(F.col("_order").alias("piece"), F.col("_text").alias("content"), F.col("_n").alias("tokens"), F.lit(None).cast("bigint").alias("char_start"), F.lit(None).cast("bigint").alias("char_end"), F.lit(None).cast("int").alias("boundary"))
    )
    cut = cut.select(*kept, F.size(F.coalesce("_pieces", whole)).alias("n_pieces"), F.explode(F.coalesce("_pieces", whole)).alias("_p"))
    return cut.select(
        *kept, F.col("_p.content").alias(content), F.col("_p.tokens").alias("tokens"), F.col("_p.piece").alias(order), "n_pieces",
        F.col("_p.char_start").alias("char_start"), F.col("_p.char_end").alias("char_end"), F.col("_p.boundary").alias("boundary"),
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows alike in every column count once."""
    return df.dropDuplicates()
