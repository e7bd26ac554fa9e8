"""Figures and distributions of columns that the caller declares to hold numbers or dates.

Numbers are compared as doubles, integers as decimals of 38 digits. Dates have no time zone. Quantiles are exact: equal values are
counted first, and the counted values are range-partitioned to find the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.validators import is_date, is_datetime, is_integer, is_number
from ..table import Table
from .ranking import with_running_total
from .shares import share_of, total_of

# Declared type -> (check, Spark type of the parsed value)
PARSERS = {
    "integer": (is_integer, "decimal(38,0)"),
    "number": (is_number, "double"),
    "YYYY-MM-DD": (is_date, "date"),
    "YYYY-MM-DD HH:MM:SS": (is_datetime, "timestamp_ntz"),
}
QUANTILES = (0.25, 0.5, 0.75)
INTERVALS = ("day", "week", "month")


def parsed(source: Table, name: str, value_type: str) -> Column:
    """The value as number or date; NULL when it is missing or does not fit.

    An integer of more than 38 digits does not fit.
    """
    check, spark_type = PARSERS[value_type]
    text = source.text(name)
    fits = source.present(name) & check(text)
    return F.when(fits, strip(text).try_cast(spark_type))


def parse_counts(source: Table, name: str, value_type: str) -> DataFrame:
    """Rows, missing values, and values that do and do not fit the declared type."""
    rows = source.df.select(
        source.missing(name).alias("missing"),
        parsed(source, name, value_type).isNotNull().alias("fits"),
    )
    missing, fits = F.col("missing"), F.col("fits")
    return rows.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(missing).alias("missing_count"),
        F.count_if(fits).alias("parseable_count"),
        F.count_if(~missing & ~fits).alias("unparseable_count"),
    )


def value_summary(
    source: Table, name: str, value_type: str, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """Counts, minimum, maximum and exact quantiles as one row.

    Number quantiles interpolate between neighbours, those of integers to six decimals (NULL beyond
    32 digits); date quantiles are observed dates, the first whose share of the values reaches the
    quantile. Runs the job that ranks the values.
    """
    rows = source.df.select(
        parsed(source, name, value_type).alias("value"), source.missing(name).alias("missing")
    )
    # Rows without a parsed value are one group that takes up no ranks.
    counted = (
        rows.groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"), F.count_if("missing").alias("missing"))
        .withColumn("ranks", F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.col("count")))
    )
    ranked = with_running_total(counted, [F.col("value")], "ranks", "last")
    ranked = ranked.withColumn("first", F.col("last") - F.col("ranks") + 1)
    spark_type = PARSERS[value_type][1]
    input_rows, missing, parseable = (
        F.coalesce(F.sum(column), F.lit(0)) for column in ("count", "missing", "ranks")
    )
    return ranked.agg(
        input_rows.alias("input_rows"),
        missing.alias("missing_count"),
        parseable.alias("parseable_count"),
        (input_rows - missing - parseable).alias("unparseable_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        *[_quantile(quantile, spark_type).alias(f"q{quantile:g}") for quantile in quantiles],
    )


def _quantile(quantile: float, spark_type: str) -> Column:
    total = F.col("grand_total")

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("value")))

    if spark_type in ("date", "timestamp_ntz"):
        return at(F.greatest(F.ceil(total * F.lit(quantile)), F.lit(1)))
    place = (total - 1) * F.lit(quantile)
    low, high = F.floor(place), F.ceil(place)
    below, above = at(low + 1), at(high + 1)
    part = F.max(place - low)
    if spark_type == "double":
        return below + (above - below) * part
    # Neighbours of 32 digits leave six for the decimals; what is wider has no quantile.
    start, gap = below.try_cast("decimal(38,6)"), (above - below).try_cast("decimal(31,0)")
    return (start + gap * part.cast("decimal(7,6)")).try_cast("decimal(38,6)")


def histogram(source: Table, name: str, value_type: str = "number", bins: int = 10) -> DataFrame:
    """Counts in equally wide bins from minimum to maximum, empty bins included.

    Shares are over the values that fit the type. Only finite values can be put in a bin.
    """
    values = source.df.select(parsed(source, name, value_type).cast("double").alias("value"))
    finite = values.where(F.col("value").isNotNull() & (F.abs("value") < F.lit(float("inf"))))
    bounds = finite.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")))
    bounds = bounds.scalar()
    low, high = bounds["low"], bounds["high"]
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    binned = (
        finite.withColumns({"low": low, "high": high})
        .select(
            F.when(F.col("high") == F.col("low"), F.lit(0))
            .otherwise(F.least(place, F.lit(bins - 1)))
            .cast("int")
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spark = source.df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return (
        every.join(F.broadcast(binned), "bin", "left")
        .withColumns({"low": low, "high": high, "total": total_of(binned)})
        .where(F.col("low").isNotNull())
        .select(
            "bin",
            (F.col("low") + width * F.col("bin")).alias("lower_bound"),
            (F.col("low") + width * (F.col("bin") + 1)).alias("upper_bound"),
            F.coalesce("count", F.lit(0)).alias("count"),
            share_of(F.coalesce("count", F.lit(0)), F.col("total")).alias("share"),
        )
    )


def date_counts(source: Table, name: str, date_format: str = "YYYY-MM-DD", interval: str = "day") -> DataFrame:
    """Values per day, week (from Monday) or month. Shares are over the values that fit."""
    if interval not in INTERVALS:
        raise ValueError(f"Unknown interval {interval!r}.")
    values = source.df.select(parsed(source, name, date_format).alias("value"))
    counted = (
        values.where("value is not null")
        .groupBy(F.date_trunc(interval, "value").cast("date").alias("period"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.withColumn("share", share_of(F.col("count"), total_of(counted)))
