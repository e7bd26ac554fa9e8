"""Mixing sources to target weights by hash thresholds, without a sort of the documents.

Sizes are summed by source and hash bucket; in every source one bucket holds the threshold, and only
that bucket is split further until a single hash decides. A document is taken when its hash is under
its source's threshold, so smaller budgets always give subsets of larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, stored

HASH_BITS, STEP_BITS = 60, 10


def with_size(docs: DataFrame) -> DataFrame:
    """Add ``_size`` (words) and ``_hash`` (60 bits, the same for equal documents)."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), ""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    code = F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.withColumns({"_size": words.cast("long"), "_hash": code})


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """One row per source (``_source, _total``): its target, shared by weight and capped.

    Sources in code point order with null last take the weights in turn. What a cap leaves over goes
    to the others by weight: the cap that binds first has the least cap per weight.
    """
    order = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    table = sizes.withColumn("_weight", F.array(*[F.lit(float(w)) for w in weights])[turn])
    table = table.withColumn("_cap", (max_repeats * F.col("_total")).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    table = table.withColumns(
        {
            "_all": F.sum("_total").over(whole).cast("double"),
            "_left": F.sum("_total").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_open": F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # The level is the rate at the first source whose cap does not bind.
    table = table.withColumns({"_rate": F.col("_left") / F.col("_open"), "_ratio_rank": F.row_number().over(by_ratio)})
    free = F.when(F.col("_cap") >= F.col("_rate") * F.col("_weight"), F.struct("_ratio_rank", "_rate"))
    table = table.withColumn("_level", F.min(free).over(whole)["_rate"])
    return table.select("_source", "_total", F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), "_cap")).alias("_target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per document with size, source_size, target and taken.

    ``taken`` is the size times the full passes over the source, plus once more for documents whose
    hash is at most the threshold; the document that crosses the budget is taken if that comes nearer
    to it. Null text has size 0, null sources are one source, equal documents (id and text) are taken
    together; documents without words take nothing. An empty table gives an empty result.
    """
    slim = with_size(docs.select("doc_id", "text", F.col("source").cast("string").alias("_source"))).drop("text")
    slim = stored(slim, "mix-sizes")
    goal = plan(slim, weights, max_repeats).withColumnRenamed("_source", "_t_source")
    joined = slim.join(within_bound(goal), F.col("_source").eqNullSafe(F.col("_t_source")))
    return joined.select(
        "doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * copies()).alias("taken"),
    )


def copies():
    """Full passes, and one more at or below the threshold."""
    return F.col("_passes") + F.when(F.col("_hash") <= F.col("_threshold"), 1).otherwise(0)


def plan(slim: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source: target, full passes and the threshold of the last, partial pass."""
    sums = slim.groupBy("_source").agg(F.sum("_size").alias("_total"))
    goal = targets(sums, weights, max_repeats)
    full = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total") + 1e-12)).otherwise(0).cast("long")
    goal = goal.withColumn("_passes", full)
    goal = stored(goal.withColumn("_rest", F.col("_target") - F.col("_passes") * F.col("_total")), "mix-targets")
    found = thresholds(slim, goal)
    return stored(goal.join(found, F.col("_source").eqNullSafe(F.col("_t_source")), "left").drop("_t_source"), "mix-plan")


MAX_BROADCAST_ROWS = 10_000


def within_bound(table: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if its counted size allows it."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def thresholds(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """Largest hash to take of each source (``_t_source, _threshold``)."""
    # The state of a source: the bucket that is still open, and what the buckets below it hold.
    start = F.lit(0).cast("long")
    state = goal.select(F.col("_source").alias("_t_source"), start.alias("_prefix"), start.alias("_below"), "_rest")
    for done in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        parent = F.shiftright("_hash", done + STEP_BITS)
        rows = slim.join(within_bound(state), F.col("_source").eqNullSafe(F.col("_t_source")) & (parent == F.col("_prefix")))
        # Combined within the tasks: at most 1024 rows per source and task are shuffled.
        table = rows.groupBy("_t_source", "_below", "_rest", F.shiftright("_hash", done).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi")
        )
        table = table.withColumn("_upto", F.col("_below") + F.sum("_sum").over(Window.partitionBy("_t_source").orderBy("_bucket")))
        first = F.min(F.struct("_bucket", "_upto", "_sum", "_lo", "_hi")).alias("_x")
        table = table.where("_upto >= _rest").groupBy("_t_source", "_rest").agg(first)
        state = table.select(
            "_t_source", F.col("_x._bucket").alias("_prefix"), (F.col("_x._upto") - F.col("_x._sum")).alias("_below"), "_rest",
            F.col("_x._upto").alias("_upto"), F.col("_x._hi").alias("_last"), (F.col("_x._lo") < F.col("_x._hi")).alias("_many"),
        )
        state = stored(state, "mix-state")
        if not state.where("_many").limit(1).count():
            break
    take = (F.col("_upto") - F.col("_rest")) <= F.greatest(F.lit(0.0), F.col("_rest") - F.col("_below"))
    return state.select("_t_source", F.when(take, F.col("_last")).otherwise(F.col("_last") - 1).alias("_threshold"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with a column ``copies``: how often the mix takes the row; rows taken never are gone.

    Where ``docs`` has a column of that name, the new one is ``copies_2``, or the next free number.
    Other cases as in ``mix``: rows without a word are never taken, null sources are one source,
    equal documents are taken together, an empty table gives an empty result.
    """
    have, name, number = {c.lower() for c in docs.columns}, "copies", 1
    while name in have:
        number += 1
        name = f"copies_{number}"
    row = docs.select(F.struct("*").alias("_row"))
    row = row.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_row.source").cast("string").alias("_source"))
    goal = plan(stored(with_size(row.drop("_row")).drop("text"), "mix-sizes"), **options)
    joined = with_size(row).join(within_bound(goal.withColumnRenamed("_source", "_t_source")), F.col("_source").eqNullSafe(F.col("_t_source")))
    taken = joined.withColumn("_copies", copies()).where("_copies > 0")
    return taken.select("_row.*", F.col("_copies").alias(name))
