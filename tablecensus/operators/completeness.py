"""Column completeness and the figures derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import Table
from .masks import BITS, is_present, mask_names, packed_rows
from .shares import share_of


def row_count(source: Table) -> DataFrame:
    return source.df.agg(F.count(F.lit(1)).alias("input_rows"))


def column_completeness(source: Table) -> DataFrame:
    """Present and missing counts and shares of every column, from one scan."""
    if len(source.names) > BITS:
        return _wide_completeness(source)
    counts = packed_rows(source, source.names).agg(
        F.count(F.lit(1)).alias("input_rows"),
        *[F.count_if(is_present(i)).alias(f"p{i}") for i in range(len(source.names))],
    )
    return completeness_rows(counts, source.names)


def _wide_completeness(source: Table) -> DataFrame:
    """The masks become rows, so the aggregate has one size for any number of columns."""
    masks = mask_names(source.names)
    packed = packed_rows(source, source.names).toDF(*map(str, range(len(masks))))
    counts = (
        packed.unpivot([], packed.columns, "mask", "mask0")
        .groupBy(F.col("mask").cast("int").alias("mask"))
        .agg(
            F.count(F.lit(1)).alias("input_rows"),
            F.array(*[F.count_if(is_present(i)) for i in range(BITS)]).alias("present"),
        )
        .select("mask", "input_rows", F.posexplode("present").alias("place", "present_count"))
        .select((F.col("mask") * BITS + F.col("place")).alias("counted"), "input_rows", "present_count")
    )
    # One row per column: the columns of an empty table stay in the result.
    spark = source.df.sparkSession
    columns = spark.range(len(source.names)).select(F.col("id").cast("int").alias("column_index"))
    joined = columns.join(F.broadcast(counts), F.col("column_index") == F.col("counted"), "left")
    names = F.array(*[F.lit(name) for name in source.names])
    return _with_shares(
        joined.select(
            "column_index",
            F.element_at(names, F.col("column_index") + 1).alias("column_name"),
            F.coalesce("input_rows", F.lit(0)).alias("input_rows"),
            F.coalesce("present_count", F.lit(0)).alias("present_count"),
        )
    )


def completeness_rows(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Turn one wide row of present counts (``p0``, ``p1``, ...) into one row per column."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("column_index"),
                F.lit(name).alias("column_name"),
                F.col("input_rows"),
                F.col(f"p{i}").alias("present_count"),
            )
            for i, name in enumerate(names)
        ]
    )
    return _with_shares(counts.select(F.inline(entries)))


def _with_shares(counts: DataFrame) -> DataFrame:
    missing_count = F.col("input_rows") - F.col("present_count")
    return counts.select(
        "column_index",
        "column_name",
        "input_rows",
        "present_count",
        share_of(F.col("present_count"), F.col("input_rows")).alias("present_share"),
        missing_count.alias("missing_count"),
        share_of(missing_count, F.col("input_rows")).alias("missing_share"),
    )


def dataset_health(completeness: DataFrame) -> DataFrame:
    """Cell counts over the whole table, from the result of ``column_completeness``."""
    present, missing = F.sum("present_count"), F.sum("missing_count")
    # A table without cells counts as complete.
    share = F.when(present + missing > 0, present.cast("double") / (present + missing))
    return completeness.agg(
        (present + missing).alias("total_cells"),
        present.alias("present_cells"),
        missing.alias("missing_cells"),
        F.coalesce(share, F.lit(1.0)).alias("completeness_share"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
    )


def completeness_level(share: Column) -> Column:
    percent = F.floor(share * 100 + 0.5)
    return F.when(percent < 50, "low").when(percent < 90, "moderate").when(percent >= 90, "high")


def with_level(completeness: DataFrame) -> DataFrame:
    return completeness.withColumn("level", completeness_level(F.col("present_share")))


def order_columns(completeness: DataFrame, by: str = "missing") -> DataFrame:
    """Columns by missing share, by present share, or as in the source."""
    leading = {
        "missing": [F.desc("missing_share")],
        "present": [F.desc("present_share")],
        "source": [],
    }
    if by not in leading:
        raise ValueError(f"Unknown column order {by!r}.")
    return completeness.orderBy(*leading[by], "column_index")
