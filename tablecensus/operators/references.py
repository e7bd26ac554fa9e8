"""Check the keys of one table against the keys of another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selection import ColumnSelectionError, choose_columns
from ..table import Table


def key_reference_check(
    left: Table, left_columns: Sequence[str], right: Table, right_columns: Sequence[str]
) -> DataFrame:
    """Matched and unmatched distinct keys and rows of both sides, as one row.

    A key with a missing part matches nothing and is counted apart. The keys of both tables are
    counted in one grouped pass, so a frequent key is combined before the shuffle and no rows are
    joined.
    """
    left_columns = choose_columns(left.names, left_columns)
    right_columns = choose_columns(right.names, right_columns)
    if len(left_columns) != len(right_columns):
        raise ColumnSelectionError("Both keys need the same number of columns.")
    keys = [f"k{i}" for i in range(len(left_columns))]

    def side(source: Table, columns: Sequence[str], is_left: int) -> DataFrame:
        values = [source.value(name).alias(key) for name, key in zip(columns, keys)]
        return source.df.select(*values, F.lit(is_left).alias("is_left"))

    counted = (
        side(left, left_columns, 1)
        .unionAll(side(right, right_columns, 0))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("is_left") == 1).alias("left_rows"),
            F.count_if(F.col("is_left") == 0).alias("right_rows"),
        )
    )
    missing = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    in_left, in_right = F.col("left_rows") > 0, F.col("right_rows") > 0
    whole = ~missing

    def keys_where(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    def rows_where(condition: Column, rows: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(rows))), F.lit(0)).alias(name)

    return counted.agg(
        keys_where(whole & in_left, "left_keys"),
        keys_where(whole & in_right, "right_keys"),
        keys_where(whole & in_left & in_right, "matched_keys"),
        keys_where(whole & in_left & ~in_right, "left_unmatched_keys"),
        keys_where(whole & ~in_left & in_right, "right_unmatched_keys"),
        rows_where(whole & in_right, "left_rows", "left_matched_rows"),
        rows_where(whole & ~in_right, "left_rows", "left_unmatched_rows"),
        rows_where(missing, "left_rows", "left_missing_key_rows"),
        rows_where(missing, "right_rows", "right_missing_key_rows"),
    )
