"""Present/missing statuses of a row packed into the bits of one long per 62 columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import Table

BITS = 62
# Beyond this many columns the code that Spark generates for a whole stage gets too long for the
# JVM to compile.
STAGE_COLUMNS = 16


def mask_names(columns: Sequence[str]) -> list[str]:
    return [f"mask{i}" for i in range(-(-len(columns) // BITS))]


def is_present(position: int) -> Column:
    return F.col(f"mask{position // BITS}").bitwiseAND(bit(position)) != 0


def bit(position: int) -> Column:
    return F.lit(1 << (position % BITS)).cast("long")


def packed_rows(source: Table, columns: Sequence[str], others: Sequence[Column] = ()) -> DataFrame:
    """One row per source row: the masks of the columns, then the other given columns."""
    present = [source.present(name) for name in columns]
    if len(columns) > STAGE_COLUMNS:
        present[0] = _outside_whole_stage(source.raw(columns[0])) & present[0]
    masks = []
    for start in range(0, len(columns), BITS):
        bits = [
            F.when(flag, bit(i)).otherwise(F.lit(0).cast("long"))
            for i, flag in enumerate(present[start : start + BITS])
        ]
        masks.append(reduce(Column.bitwiseOR, bits))
    return source.df.select(
        *[mask.alias(name) for mask, name in zip(masks, mask_names(columns))], *others
    )


def _outside_whole_stage(column: Column) -> Column:
    """Is the column not NULL, asked through an array function.

    Spark keeps a projection with such a function out of the whole-stage code. It then compiles
    the projection on its own, split into methods short enough for the JVM to compile: three times
    as fast at 60 columns.
    """
    return F.transform(F.array(column.isNotNull()), lambda flag: flag)[0]
