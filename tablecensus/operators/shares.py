"""Shares of a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(part: Column, total: Column) -> Column:
    """An unrounded double; NULL when there is nothing to divide by."""
    return F.when(total > 0, part.cast("double") / total.cast("double"))


def total_of(counts: DataFrame, column: str = "count") -> Column:
    """The sum of a grouped result as a scalar subquery.

    Spark reuses the shuffle of the grouped result for it, so the source is scanned once.
    """
    return counts.agg(F.sum(column)).scalar()
