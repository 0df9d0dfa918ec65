"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals (``a`` of the left, ``b`` of the right) overlap:
    each starts before the other ends. An equi-join on stretches of ``width`` places, so a long document's
    rows meet only those near them; a pair is kept in the stretch where its overlap begins. Intervals should
    mostly be shorter than a stretch, as a row goes to all that it touches."""
    stretches = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(F.col(hi) - 1, F.col(lo)) / width)))
    met = left.withColumn("_at", stretches(*a)).join(right.withColumn("_at", stretches(*b)), [*keys, "_at"])
    begins = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return met.where((F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0])) & (F.col("_at") == begins)).drop("_at")
