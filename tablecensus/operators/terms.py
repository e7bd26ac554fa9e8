"""Exact values of a column, how often they occur, and the formats behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing
from ..functions.text import format_skeleton, structural_format
from ..plans.selection import choose_columns
from ..table import Table
from .shares import share_of


def term_counts(source: Table, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_index, value, count)``, every missing value as one NULL term.

    All columns share one shuffle, and equal values are combined before it. The other functions
    here start from this result; persist it when several of them are needed.
    """
    chosen = choose_columns(source.names, source.names if columns is None else columns)
    labels = [str(source.position(name)) for name in chosen]
    texts = source.df.select(*[source.text(name).alias(label) for name, label in zip(chosen, labels)])
    cells = texts.unpivot([], labels, "column_label", "text")
    # The missing rule stands behind the unpivot, once per set of markers and not once per column.
    value = F.when(~_missing_cell(source, chosen), F.col("text")).alias("value")
    # Spark would filter a nullable index before some joins, and then not share the shuffle.
    index = F.coalesce(F.col("column_label").cast("int"), F.lit(0)).alias("column_index")
    return (
        cells.select("column_label", value)
        .groupBy("column_label", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(index, "value", "count")
    )


def _missing_cell(source: Table, columns: Sequence[str]) -> Column:
    labels_by_markers: dict[frozenset[str], list[str]] = {}
    for name in columns:
        markers = source.markers.get(name, frozenset())
        labels_by_markers.setdefault(markers, []).append(str(source.position(name)))
    rule = None
    for markers, labels in labels_by_markers.items():
        missing = is_missing(F.col("text"), markers)
        rule = missing if rule is None else F.when(F.col("column_label").isin(labels), missing).otherwise(rule)
    return rule


def column_name(source: Table) -> Column:
    """Give the display name beside a ``column_index``."""
    names = F.array(*[F.lit(name) for name in source.names])
    return F.element_at(names, F.col("column_index") + 1).alias("column_name")


def _input_rows(counts: DataFrame) -> Column:
    # Every selected column counts every row once.
    totals = counts.groupBy("column_index").agg(F.sum("count").alias("rows"))
    return totals.agg(F.max("rows")).scalar()


def formal_terms(
    source: Table, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    counts = term_counts(source, columns) if counts is None else counts
    return counts.select(
        "column_index",
        column_name(source),
        "value",
        "count",
        share_of(F.col("count"), _input_rows(counts)).alias("share"),
    )


def structural_formats(
    source: Table, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Formats that at least two distinct terms of a column have in common."""
    counts = term_counts(source, columns) if counts is None else counts
    # The costly format text is written once per skeleton, after the terms are combined. Terms
    # without digits share the NULL skeleton. They are dropped by an aggregate, because a plain
    # filter would be pushed below the shuffle and keep it from being shared with the total.
    value = F.col("value")
    skeleton = F.when(value.rlike("[0-9]"), format_skeleton(value))
    formats = (
        counts.select("column_index", skeleton.alias("skeleton"), "count")
        .groupBy("column_index", "skeleton")
        .agg(
            F.sum("count").alias("occurrence_count"),
            F.count(F.lit(1)).alias("distinct_term_count"),
            F.bool_or(F.col("skeleton").isNotNull()).alias("has_digits"),
        )
        .where(F.col("has_digits") & (F.col("distinct_term_count") >= 2))
        .withColumn("pattern", structural_format(F.col("skeleton")))
    )
    return formats.select(
        "column_index",
        column_name(source),
        "pattern",
        "occurrence_count",
        "distinct_term_count",
        share_of(F.col("occurrence_count"), _input_rows(counts)).alias("share"),
    )


def distinct_terms(
    source: Table, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """How many terms each column has; the missing term counts as one."""
    counts = term_counts(source, columns) if counts is None else counts
    return (
        counts.groupBy("column_index")
        .agg(F.count(F.lit(1)).alias("distinct_term_count"), F.sum("count").alias("input_rows"))
        .select("column_index", column_name(source), "distinct_term_count", "input_rows")
    )


def top_terms(
    source: Table,
    columns: Sequence[str] | None = None,
    limit: int = 10,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The most frequent present terms of each column, ties in byte order of the text.

    ``share`` is over all rows, ``share_of_present`` over the rows with a value.
    """
    counts = term_counts(source, columns) if counts is None else counts
    is_missing = F.col("value").isNull()
    # One row per selected column, so it can always be broadcast.
    totals = counts.groupBy("column_index").agg(
        F.sum("count").alias("input_rows"),
        F.sum(F.when(~is_missing, F.col("count"))).alias("present_rows"),
    )
    # Spark keeps the best rows per column in every partition before they are shuffled.
    best = Window.partitionBy("column_index").orderBy(is_missing, F.desc("count"), "value")
    ranked = (
        counts.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
        .where(~is_missing)
    )
    return ranked.join(F.broadcast(totals), "column_index").select(
        "column_index",
        column_name(source),
        "rank",
        "value",
        "count",
        share_of(F.col("count"), F.col("input_rows")).alias("share"),
        share_of(F.col("count"), F.col("present_rows")).alias("share_of_present"),
    )
