"""Evidence: constructors, union, deduplication, caps, citations, transcript windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.operators.tables import first_by_key

COLUMNS = ("id", "type", "score", "snippet", "source", "video_name", "segment_index", "time_range", "validated", "metadata")
FIRST_POOL, PER_ROUND = 24, 3


def _evidence(id_: Column, kind: str, score: Column, snippet: Column, source: str, video=None, index=None, time=None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        id_.cast("string").alias("id"), F.lit(kind).alias("type"), score.cast("double").alias("score"), F.coalesce(snippet, F.lit("")).alias("snippet"), F.lit(source).alias("source"),
        (none if video is None else video).alias("video_name"), (none if index is None else index.cast("string")).alias("segment_index"), (none if time is None else time).alias("time_range"),
        F.lit(False).alias("validated"), F.lit(None).cast("map<string,string>").alias("metadata"),
    ]


def text_evidence(hits: DataFrame) -> DataFrame:
    """From ``id, score, content``; keeps ``ord`` if there is one."""
    return hits.select(*_evidence(F.col("id"), "text", F.col("score"), F.col("content"), "text_chunk"), *[c for c in hits.columns if c == "ord"])


def entity_evidence(hits: DataFrame) -> DataFrame:
    """From ``entity_name, score, description``; the name is the id."""
    return hits.select(*_evidence(F.col("entity_name"), "entity", F.col("score"), F.col("description"), "entity"), *[c for c in hits.columns if c == "ord"])


def segment_evidence(hits: DataFrame) -> DataFrame:
    """From ``id, score`` and the segment's ``video_name, segment_index, start_s, end_s, content`` (null if it is missing)."""
    time = F.concat_ws("-", F.col("start_s").cast("string"), F.col("end_s").cast("string"))
    return hits.select(*_evidence(F.col("id"), "segment", F.col("score"), F.col("content"), "video_segment", F.col("video_name"), F.col("segment_index"), F.when(time != "", time)), *[c for c in hits.columns if c == "ord"])


def union_in_order(parts: list[DataFrame], order: str = "ord") -> DataFrame:
    """All parts one after the other; ``ord`` within a part is kept, ``branch`` numbers the parts."""
    out = None
    for k, part in enumerate(parts):
        one = part.withColumn("branch", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def dedup(evidence: DataFrame, order: tuple[str, ...] = ("branch", "ord")) -> DataFrame:
    """The first row of each id."""
    return first_by_key(evidence, "id", list(order))


def cap(evidence: DataFrame, max_rounds: int = 0, order: tuple[str, ...] = ("branch", "ord", "id"), first: int = FIRST_POOL, more: int = PER_ROUND) -> DataFrame:
    """The first ``first + more * max_rounds`` rows in order."""
    return evidence.orderBy(*order).limit(first + more * max_rounds)


def public(evidence: DataFrame, length: int = 300) -> DataFrame:
    """Evidence as shown to others: the snippet is cut."""
    return evidence.withColumn("snippet", F.substring("snippet", 1, length))


def listing(evidence: DataFrame, order: tuple[str, ...], limit: int = 50) -> DataFrame:
    """One text with a line for each of the first rows, the score with three decimals."""
    line = F.format_string("[%s] (%s, %.3f) %s", F.col("id"), F.col("type"), F.coalesce("score", F.lit(0.0)), F.col("snippet"))
    top = evidence.orderBy(*order).limit(limit).withColumn("_p", F.row_number().over(Window.orderBy(*order))).select("_p", line.alias("_l"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_l"))), lambda x: x["_l"]), "\n").alias("listing"))


def refinable(evidence: DataFrame, refined: DataFrame) -> DataFrame:
    """Segments that have no refined content yet; ``refined`` has ``id, content``."""
    return evidence.filter(F.col("type") == "segment").join(refined.select("id"), "id", "left_anti")


def use_refined(evidence: DataFrame, refined: DataFrame) -> DataFrame:
    """Evidence with refined content where there is one."""
    new = refined.select("id", F.col("content").alias("_c"))
    return evidence.join(new, "id", "left").withColumn("snippet", F.coalesce("_c", "snippet")).drop("_c")


def check_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (``id`` and any more) with ``valid``: is there evidence of that id."""
    known = evidence.select("id").distinct().withColumn("_k", F.lit(True))
    return citations.join(known, "id", "left").withColumn("valid", F.coalesce("_k", F.lit(False))).drop("_k")


def mark_cited(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Evidence with ``validated`` set where a citation names it."""
    cited = citations.select("id").distinct().withColumn("_c", F.lit(True))
    return evidence.join(cited, "id", "left").withColumn("validated", F.coalesce("_c", "validated")).drop("_c")


def last_messages(transcript: DataFrame, group: list[str], order: str, n: int = 10) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return transcript.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def relevant_or_all(rows: DataFrame, group: list[str], keep: str) -> DataFrame:
    """Rows a filter kept; all rows of a group in which it kept none (null counts as no)."""
    kept = F.coalesce(F.col(keep), F.lit(False))
    out = rows.withColumn("_k", kept).withColumn("_any", F.max("_k").over(Window.partitionBy(*group)))
    return out.filter(F.col("_k") | ~F.col("_any")).drop("_k", "_any")
