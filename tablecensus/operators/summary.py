"""Order, filter and shorten summary results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_casefolded
from ..plans.row_filters import Contains, Exact, Missing, parse_filters
from ..table import by_position, exact_position, physical
from .ranking import with_running_total

TOP_ENTRIES = 10


def _canonical(names: Sequence[str], keys: Sequence[str], count: str) -> list[Column]:
    return [
        F.desc(physical(exact_position(names, count))),
        *[F.asc_nulls_first(physical(exact_position(names, key))) for key in keys],
    ]


def _ordered(positional: DataFrame, names: Sequence[str], order: list[Column], position: str | None) -> DataFrame:
    """Sorted; with the place of each entry, counted from 1, where a column for it is named."""
    if position is None:
        return positional.orderBy(*order).toDF(*names)
    placed = with_running_total(positional, order, name="_position").drop("grand_total")
    return placed.orderBy("_position").toDF(*names, position)


def canonical_order(result: DataFrame, keys: Sequence[str], count: str = "count", position: str | None = None) -> DataFrame:
    """By count, highest first; ties by the keys in byte order with NULL first.

    ``position`` names a column for the place of each entry; finding it runs the job that sorts.
    """
    positional, names = by_position(result)
    return _ordered(positional, names, _canonical(names, keys, count), position)


def top_entries(
    result: DataFrame, keys: Sequence[str], count: str = "count", limit: int = TOP_ENTRIES
) -> DataFrame:
    return canonical_order(result, keys, count).limit(limit)


def sort_summary(
    result: DataFrame,
    by: str,
    descending: bool = False,
    keys: Sequence[str] = (),
    count: str = "count",
    locale_text: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Sort by one column; equal entries keep the canonical order.

    NULL comes first ascending and last descending. ``locale_text`` ignores case and accents.
    ``position`` is as in ``canonical_order``.
    """
    positional, names = by_position(result)
    column = F.col(physical(exact_position(names, by)))
    if locale_text:
        column = F.collate(column, "UNICODE_CI_AI")
    leading = column.desc_nulls_last() if descending else column.asc_nulls_first()
    return _ordered(positional, names, [leading, *_canonical(names, keys, count)], position)


def filter_summary(result: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Entries that satisfy every filter. Missing means a NULL entry here."""
    positional, names = by_position(result)
    for name, wanted in parse_filters(filters).items():
        column = F.col(physical(exact_position(names, name)))
        match wanted:
            case Contains(value):
                positional = positional.where(contains_casefolded(column.cast("string"), value))
            case Exact(value):
                positional = positional.where(column.cast("string") == F.lit(value))
            case Missing():
                positional = positional.where(column.isNull())
    return positional.toDF(*names)
