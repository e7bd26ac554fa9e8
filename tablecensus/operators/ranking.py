"""Positions and running totals over a whole table without sending it through one task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        configured = tempfile.mkdtemp(prefix="tablecensus-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def with_running_total(
    df: DataFrame, order: Sequence[Column], weight: str | None = None, name: str = "running_total"
) -> DataFrame:
    """Add the total of ``weight`` (or the row count) up to each row, and ``grand_total``.

    The rows are range-partitioned by the order and checkpointed, so the partition totals and
    the rows belong to the same partitioning even when tasks are repeated. Runs that one job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright(F.col("_place"), POSITION_BITS)
    placed = placed.withColumn("_part", part)
    amount = F.lit(1) if weight is None else F.col(weight)
    # One row per partition: small enough for one window and for a broadcast.
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_part_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_part_total").over(before), F.lit(0)).alias("_start"),
        F.sum("_part_total").over(everything).alias("grand_total"),
    )
    within = (
        F.col("_place").bitwiseAND((1 << POSITION_BITS) - 1) + 1
        if weight is None
        else F.sum(amount).over(
            Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_place", "_start")
    )
