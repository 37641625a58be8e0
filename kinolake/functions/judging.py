"""Validation of judge output and small control expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The judged criteria.
METRICS = ("Comprehensiveness", "Empowerment", "Trustworthiness", "Depth", "Density")
WINNER_METRICS = (*METRICS, "Overall Winner")
SCORE_METRICS = (*METRICS, "Overall Score")
WINNER_TYPE = "map<string, struct<Winner: string, Explanation: string>>"
SCORE_TYPE = "map<string, struct<Score: int, Explanation: string>>"


def _exact_keys(judged: Column, metrics: tuple[str, ...]) -> Column:
    return F.array_sort(F.map_keys(judged)) == F.array(*[F.lit(m) for m in sorted(metrics)])


def valid_winners(judged: Column) -> Column:
    """Exactly the six criteria, each with ``Answer 1`` or ``Answer 2`` and an explanation; null is invalid."""
    ok = F.forall(F.map_values(judged), lambda v: v["Winner"].isin("Answer 1", "Answer 2") & v["Explanation"].isNotNull())
    return F.coalesce(_exact_keys(judged, WINNER_METRICS) & ok, F.lit(False))


def valid_scores(judged: Column) -> Column:
    """Exactly the six criteria, each with a score from 1 to 5 and an explanation; null is invalid."""
    ok = F.forall(F.map_values(judged), lambda v: v["Score"].between(1, 5) & v["Explanation"].isNotNull())
    return F.coalesce(_exact_keys(judged, SCORE_METRICS) & ok, F.lit(False))


def next_poll_delay(current: Column, least: int, most: int, progressed: Column) -> Column:
    """Doubles within bounds; back to the least on progress."""
    return F.when(progressed, F.lit(least)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), current * 2)))


def verdict(answer_json: Column) -> Column:
    """``struct<answer, rationale, confidence>`` of a judge's JSON with either spelling of the keys."""
    get = lambda *names: F.coalesce(*[F.get_json_object(answer_json, "$." + n) for n in names])
    return F.struct(
        F.coalesce(get("Answer", "answer"), F.lit("")).alias("answer"), F.coalesce(get("Explanation", "rationale"), F.lit("")).alias("rationale"),
        F.coalesce(get("Confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
    )
