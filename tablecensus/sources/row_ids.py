"""Row ids that sort in source order, taken from file positions without a sort or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import ROW_ID


def file_line_id() -> Column:
    """For text-based scans: file, start of the split, and the running number inside it."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def with_file_row_id(df: DataFrame) -> DataFrame:
    """Add ``_row_id`` to a DataFrame read straight from Parquet files."""
    row_id = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return df.select(row_id.alias(ROW_ID), "*")


def with_row_position(df: DataFrame, name: str = "row_position") -> DataFrame:
    """Number the rows of a DataFrame read straight from Parquet files, from 0, by file path and row.

    The same files give the same numbers however they are split or read again. Two scans: one counts
    the rows of each file without reading a column, one row per file then goes to every task.
    """
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counted = df.groupBy(path.alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per file: small enough for one window and a broadcast.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    rows = df.select("*", path.alias("_path"), index.alias("_index"))
    placed = rows.join(F.broadcast(starts), F.col("_path") == F.col("_file"))
    return placed.withColumn(name, F.col("_start") + F.col("_index")).drop("_path", "_index", "_file", "_start")
