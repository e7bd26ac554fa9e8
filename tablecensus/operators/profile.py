"""One row per column with its completeness and value figures, and comparisons of such profiles."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..table import Table
from .shares import share_of
from .terms import column_name, structural_formats, term_counts, top_terms

SNAPSHOT_VERSION = 1
COMPARED = (
    "column_index",
    "input_rows",
    "present_count",
    "present_share",
    "missing_count",
    "missing_share",
    "distinct_term_count",
    "format_count",
    "rows_with_format",
)


class SnapshotError(ValueError):
    """Two snapshots cannot be compared."""


def column_profile(
    source: Table, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Completeness, distinct terms, the most frequent term and the repeated formats.

    ``distinct_term_share`` is distinct terms over all rows; ``rows_with_format`` counts the rows
    whose value has one of the repeated formats. Everything comes from the counted
    terms, whose shuffle the parts share, so the source is scanned once.
    """
    counts = term_counts(source, columns) if counts is None else counts
    gone = F.when(F.col("value").isNull(), F.col("count")).otherwise(F.lit(0))
    figures = counts.groupBy("column_index").agg(
        F.sum("count").alias("input_rows"),
        F.sum(gone).alias("missing_count"),
        F.count(F.lit(1)).alias("distinct_term_count"),
    )
    present = F.col("input_rows") - F.col("missing_count")
    # Each side has one row per column at most.
    top = top_terms(source, limit=1, counts=counts).select(
        "column_index",
        F.col("value").alias("top_term"),
        F.col("count").alias("top_term_count"),
        F.col("share_of_present").alias("top_term_share_of_present"),
    )
    formats = (
        structural_formats(source, counts=counts)
        .groupBy("column_index")
        .agg(
            F.count(F.lit(1)).alias("format_count"),
            F.sum("occurrence_count").alias("rows_with_format"),
        )
    )
    joined = figures.join(F.broadcast(top), "column_index", "left")
    joined = joined.join(F.broadcast(formats), "column_index", "left")
    return joined.select(
        "column_index",
        column_name(source),
        "input_rows",
        present.alias("present_count"),
        share_of(present, F.col("input_rows")).alias("present_share"),
        "missing_count",
        share_of(F.col("missing_count"), F.col("input_rows")).alias("missing_share"),
        "distinct_term_count",
        share_of(F.col("distinct_term_count"), F.col("input_rows")).alias("distinct_term_share"),
        "top_term",
        "top_term_count",
        "top_term_share_of_present",
        F.coalesce(F.col("format_count"), F.lit(0)).alias("format_count"),
        F.coalesce(F.col("rows_with_format"), F.lit(0)).alias("rows_with_format"),
    )


def snapshot_of(profile: DataFrame) -> DataFrame:
    """The aggregate part of a profile; terms and cell values stay out."""
    return profile.select("column_name", *COMPARED)


def snapshot_settings(source: Table) -> str:
    """The definitions that two snapshots must share, as JSON text."""
    return json.dumps(
        {
            "version": SNAPSHOT_VERSION,
            "missing_markers": {
                name: sorted(markers) for name, markers in source.markers.items() if markers
            },
        },
        sort_keys=True,
    )


def save_snapshot(source: Table, profile: DataFrame, path: str) -> None:
    settings = F.lit(snapshot_settings(source)).alias("settings")
    # One row per column of the table: a single small file.
    snapshot_of(profile).withColumn("settings", settings).coalesce(1).write.parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    stored = spark.read.parquet(path)
    first = stored.select("settings").head()
    if first is None:
        raise SnapshotError("The snapshot holds no columns.")
    return stored.drop("settings"), first["settings"]


def compare_snapshots(
    before: DataFrame,
    after: DataFrame,
    settings_before: str,
    settings_after: str,
    renamed: Mapping[str, str] | None = None,
) -> DataFrame:
    """Columns added, removed and moved, with the change of every figure.

    ``renamed`` maps old to new column names; otherwise names must be equal.
    """
    _check_compatible(settings_before, settings_after, renamed or {})
    old, new = before, after
    for old_name, new_name in (renamed or {}).items():
        old = old.withColumn(
            "column_name",
            F.when(F.col("column_name") == old_name, F.lit(new_name)).otherwise(F.col("column_name")),
        )
    old = old.select("column_name", *[F.col(name).alias(f"{name}_before") for name in COMPARED])
    new = new.select("column_name", *[F.col(name).alias(f"{name}_after") for name in COMPARED])
    joined = old.join(new, "column_name", "full_outer")
    moved = F.col("column_index_before") != F.col("column_index_after")
    change = (
        F.when(F.col("column_index_before").isNull(), "added")
        .when(F.col("column_index_after").isNull(), "removed")
        .when(moved, "reordered")
        .otherwise("same")
    )
    differences = []
    for name in COMPARED:
        differences += [F.col(f"{name}_before"), F.col(f"{name}_after")]
        if name != "column_index":
            differences.append((F.col(f"{name}_after") - F.col(f"{name}_before")).alias(f"{name}_change"))
    return joined.select("column_name", change.alias("column_change"), *differences)


def _check_compatible(before: str, after: str, renamed: Mapping[str, str]) -> None:
    old, new = json.loads(before), json.loads(after)
    if old.get("version") != SNAPSHOT_VERSION or new.get("version") != SNAPSHOT_VERSION:
        raise SnapshotError("A snapshot has a version that is not supported.")
    markers = {renamed.get(name, name): given for name, given in old["missing_markers"].items()}
    if markers != new["missing_markers"]:
        raise SnapshotError("The snapshots use different missing-value markers.")
