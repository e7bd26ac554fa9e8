"""Helpers of several operators: shared storage, lambdas over one value, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts: everything else than these six characters is a word.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, root)`` with the smallest node as root.

    Minimum labels with pointer jumping. Every round combines labels before the shuffle, so that a
    node with a third of all links is one row per task; joins read written tables and can be split.
    Links with a null end are ignored, repeated links and loops are harmless; no links, no rows.
    """
    edges = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    label = stored(first.select("node", F.least("node", "m").alias("root")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        # A root that learns of a smaller label passes it on to all nodes it stands for.
        old = label.select("node", F.col("root").alias("old"))
        lower = near.join(old, "node").where("root < old").select(F.explode(F.array("node", "old")).alias("node"), "root")
        known = label.select("node", "root", F.col("root").alias("old"))
        best = known.unionByName(lower, allowMissingColumns=True).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        above = best.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = best.join(above, "root", "left").select("node", F.least("root", "up").alias("root"), "old")
        fresh = stored(jumped, f"{name}-{round_}")
        label = fresh.select("node", "root")
        if fresh.where("root <> old").isEmpty():
            return label
