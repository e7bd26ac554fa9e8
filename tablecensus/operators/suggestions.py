"""Terms that only differ in case or surrounding whitespace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, strip
from ..table import Table, physical
from .terms import column_name, term_counts

#: Accepted terms, and bytes of them, that are sent to every task.
BROADCAST_TERMS, BROADCAST_BYTES = 100_000, 32 << 20
#: Terms that are written into the expression when there are more.
FREQUENT_TERMS = 200


def normalization_suggestions(
    source: Table, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per original term of a group of two or more, with the text proposed for it.

    The proposal is the most frequent term of the group without surrounding whitespace (ties: the
    first in byte order). Groups stay in rows, so no group has to fit in one place.
    """
    counts = term_counts(source, columns) if counts is None else counts
    terms = counts.where("value is not null").withColumn("group_key", casefold(strip(F.col("value"))))
    groups = (
        terms.groupBy("column_index", "group_key")
        .agg(
            F.count(F.lit(1)).alias("term_count"),
            F.sum("count").alias("group_rows"),
            F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("leader"),
        )
        .where("term_count > 1")
    )
    return terms.join(groups, ["column_index", "group_key"]).select(
        "column_index",
        column_name(source),
        F.col("value").alias("original_term"),
        "count",
        strip(F.col("leader")).alias("proposed_text"),
        "term_count",
        "group_rows",
    )


def apply_suggestions(source: Table, accepted: DataFrame, columns: Sequence[str]) -> Table:
    """Replace accepted terms in a copy of the table; the rows and their number stay the same.

    ``accepted`` holds the chosen rows of ``normalization_suggestions``. Suggestions listed twice
    count once; a term with two different proposals fails. Looks at the number of accepted terms:
    up to ``BROADCAST_TERMS`` of bounded length they are broadcast, beyond that the most frequent
    ones become part of the expression, so that no term with a large share of the rows is a join key.
    """
    chosen = accepted.groupBy("column_index", F.col("original_term").alias("_term")).agg(
        F.min("proposed_text").alias("_text"),
        F.max("proposed_text").alias("_other"),
        F.max("count").alias("_rows"),
    )
    facts = chosen.agg(
        F.count(F.lit(1)).alias("terms"),
        F.count_if(F.col("_text") != F.col("_other")).alias("conflicts"),
        F.sum(F.octet_length("_term") + F.octet_length("_text")).alias("bytes"),
    ).head()
    if facts["conflicts"]:
        raise ValueError(f"{facts['conflicts']} terms have more than one proposal.")
    small = facts["terms"] <= BROADCAST_TERMS and (facts["bytes"] or 0) <= BROADCAST_BYTES
    df = source.df
    for name in columns:
        index = source.position(name)
        slot = physical(index)
        own = chosen.where(F.col("column_index") == index).select("_term", "_text", "_rows")
        term = source.value(name)
        if small:
            joined, text = df.join(F.broadcast(own.drop("_rows")), term == F.col("_term"), "left"), F.col("_text")
        else:
            top = own.orderBy(F.desc("_rows"), "_term").limit(FREQUENT_TERMS).collect()
            frequent = F.create_map(*[F.lit(x) for row in top for x in (row["_term"], row["_text"])])
            ready = F.element_at(frequent, term)
            rest = own.join(F.broadcast(df.sparkSession.createDataFrame([(row["_term"],) for row in top], "_term string")), "_term", "left_anti")
            joined = df.join(rest.drop("_rows"), F.when(ready.isNull(), term) == F.col("_term"), "left")
            text = F.coalesce(ready, F.col("_text"))
        df = joined.withColumn(slot, F.coalesce(text, F.col(slot))).drop("_term", "_text")
    return Table(df, source.names, source.markers, source.order)
