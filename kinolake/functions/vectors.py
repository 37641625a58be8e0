"""Similarity expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length; null for null or lengths that differ."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) == F.size(b), value)


def score(similarity: Column, distance: Column) -> Column:
    """The similarity; without one, one minus the distance but not under 0; else 0."""
    return F.coalesce(similarity, F.greatest(F.lit(0.0), 1.0 - distance), F.lit(0.0))


def legacy_score(distance_holding_similarity: Column) -> Column:
    """The inverted score of a store that reports similarity in its distance field."""
    return F.greatest(F.lit(0.0), 1.0 - distance_holding_similarity)
