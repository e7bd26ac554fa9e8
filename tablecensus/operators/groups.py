"""Exact value tuples over chosen columns and how unique they are as keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.selection import choose_columns
from ..table import Table
from .shares import share_of, total_of


def group_counts(source: Table, columns: Sequence[str]) -> DataFrame:
    """One row per value tuple, a missing part as NULL, under positional names."""
    chosen = choose_columns(source.names, columns)
    keys = [f"k{i}" for i in range(len(chosen))]
    values = source.df.select(*[source.value(name).alias(key) for name, key in zip(chosen, keys)])
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def group_data(source: Table, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """The value tuples with count and share. Unordered; see ``summary.canonical_order``."""
    counts = group_counts(source, columns) if counts is None else counts
    shares = counts.withColumn("share", share_of(F.col("count"), total_of(counts)))
    return shares.toDF(*columns, "count", "share")


def key_uniqueness(source: Table, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Aggregated from the grouped result, without another scan. The share is over keys, not rows."""
    counts = group_counts(source, columns) if counts is None else counts
    repeated = F.col("count") > 1
    figures = counts.agg(
        F.count(F.lit(1)).alias("distinct_key_count"),
        F.count_if(F.col("count") == 1).alias("singleton_key_count"),
        F.count_if(repeated).alias("repeated_key_count"),
        F.coalesce(F.sum(F.when(repeated, F.col("count"))), F.lit(0)).alias(
            "input_rows_in_repeated_key_groups"
        ),
    )
    return figures.withColumn(
        "singleton_key_share", share_of(F.col("singleton_key_count"), F.col("distinct_key_count"))
    )
