"""The source rows behind a summary entry, with filters, projection and paging.

Entries are addressed by their key values. Every ``rows_...`` function returns a ``Table`` again,
so the steps combine freely.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import MISSING, PRESENT
from ..functions.text import contains_casefolded
from ..plans.row_filters import Contains, Exact, Missing, RowFilterError, parse_filters
from ..plans.selection import project_columns
from ..table import Table
from .ranking import with_running_total

PAGE_ROWS = 50
# Up to here Spark's top-k keeps the rows before the page in memory of each task.
SHALLOW_ROWS = 20_000

FORMAT_TOKEN = re.compile(r"<([0-9]+) digits>")


def _status_is(source: Table, name: str, wanted: str) -> Column:
    if wanted not in (PRESENT, MISSING):
        raise ValueError(f"Unknown status {wanted!r}.")
    return source.missing(name) if wanted == MISSING else source.present(name)


def _value_is(source: Table, name: str, value: str | None) -> Column:
    if value is None:
        return source.missing(name)
    if source.is_missing_value(name, value):
        return F.lit(False)
    # A plain comparison, so it can reach the file scan.
    return source.text(name) == F.lit(value)


def rows_with_status(source: Table, column: str, status: str) -> Table:
    return source.where(_status_is(source, column, status))


def rows_with_pattern(source: Table, statuses: Mapping[str, str]) -> Table:
    conditions = [_status_is(source, name, wanted) for name, wanted in statuses.items()]
    return source.where(reduce(Column.__and__, conditions))


def rows_with_term(source: Table, column: str, value: str | None) -> Table:
    """Rows with exactly this value; None asks for all missing cells."""
    return source.where(_value_is(source, column, value))


def rows_in_group(source: Table, key: Mapping[str, str | None]) -> Table:
    return source.where(reduce(Column.__and__, [_value_is(source, *part) for part in key.items()]))


def format_regex(pattern: str) -> str | None:
    """A regular expression for the values of a structural format.

    Every digit of a format belongs to one of its ``<n digits>`` parts, which makes it readable
    in one way only. None when no value can have this format.
    """
    parts = FORMAT_TOKEN.split(pattern)
    literals, widths = parts[::2], parts[1::2]
    if not widths or any(re.search("[0-9]", text) for text in literals):
        return None
    # Two neighbouring runs would have been one run.
    if any(not text for text in literals[1:-1]) or any(width.startswith("0") for width in widths):
        return None
    runs = [f"[0-9]{{{width}}}" for width in widths] + [""]
    # \Q...\E takes the literal text as it is, once its own end mark is split up.
    quoted = ["\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else "" for text in literals]
    return "\\A" + "".join(text + run for text, run in zip(quoted, runs)) + "\\z"


def rows_with_format(source: Table, column: str, pattern: str) -> Table:
    regex = format_regex(pattern)
    if regex is None:
        return source.where(F.lit(False))
    return source.where(source.present(column) & source.text(column).rlike(regex))


def filter_rows(source: Table, filters: Mapping[str, object] | None) -> Table:
    """Rows that satisfy every column filter, each under its own column's missing rule."""
    conditions = []
    for name, wanted in parse_filters(filters).items():
        if name not in source.names:
            raise RowFilterError(f"The filtered column {name!r} does not exist.")
        match wanted:
            case Contains(value):
                conditions.append(contains_casefolded(source.text(name), value))
            case Exact(value):
                conditions.append(source.text(name) == F.lit(value))
            case Missing():
                conditions.append(source.missing(name))
    return source.where(reduce(Column.__and__, conditions)) if conditions else source


def project(source: Table, analysed: Sequence[str] = (), mode: str = "all") -> DataFrame:
    return source.to_df(project_columns(source.names, analysed, mode))


def in_source_order(source: Table, columns: Sequence[str] | None = None) -> DataFrame:
    return source.to_df(columns, source.df.orderBy(*source.order_columns()))


def head(source: Table, rows: int) -> Table:
    """The first rows in source order."""
    return Table(
        source.df.orderBy(*source.order_columns()).limit(rows), source.names, source.markers, source.order
    )


@dataclass(frozen=True)
class PageIndex:
    """Ranges of the source order: the least order values of each, and the rows before it."""

    lows: tuple[Row, ...]
    starts: tuple[int, ...]
    total: int


def page_index(source: Table) -> PageIndex:
    """Where the rows of a table lie in its order; one small row per range reaches the driver.

    Only the order columns are read and range-partitioned, and nothing but the bounds and counts is
    kept. Equal order values share a range. Use it again for other pages of the same rows.
    """
    order = source.order_columns()
    keys = source.df.select(F.struct(*[column.alias(f"order{i}") for i, column in enumerate(order)]).alias("key"))
    parts = keys.repartitionByRange("key").groupBy(F.spark_partition_id().alias("part"))
    found = sorted(parts.agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("rows")).collect(), key=lambda row: row["part"])
    sizes = [row["rows"] for row in found]
    return PageIndex(tuple(row["low"] for row in found), tuple(accumulate([0, *sizes[:-1]])), sum(sizes))


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(part, field.dataType).alias(field.name) for part, field in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def _page_by_index(source: Table, index: PageIndex, offset: int, page_rows: int, columns: Sequence[str] | None) -> DataFrame:
    if offset >= index.total:
        return source.to_df(columns, source.df.where(F.lit(False)))
    order = source.order_columns()
    kinds = [source.df.select(column).schema[0].dataType for column in order]
    first = bisect_right(index.starts, offset) - 1
    after = bisect_left(index.starts, offset + page_rows)
    key = F.struct(*[column.alias(f"order{i}") for i, column in enumerate(order)])

    def bound(low: Row) -> Column:
        return F.struct(*[_literal(value, kind).alias(f"order{i}") for i, (value, kind) in enumerate(zip(low, kinds, strict=True))])

    rows = source.df.where(key >= bound(index.lows[first]))
    # The leading column alone reaches the scan, where it skips files and row groups.
    if index.lows[first][0] is not None:
        rows = rows.where(order[0] >= _literal(index.lows[first][0], kinds[0]))
    if after < len(index.lows):
        rows = rows.where(key < bound(index.lows[after]))
        if index.lows[after][0] is not None:
            rows = rows.where(order[0].isNull() | (order[0] <= _literal(index.lows[after][0], kinds[0])))
    part = with_tie(replace(source, df=rows))
    return source.to_df(columns, part.orderBy(*order, "_tie").offset(offset - index.starts[first]).limit(page_rows))


def page(
    source: Table,
    number: int,
    page_rows: int = PAGE_ROWS,
    columns: Sequence[str] | None = None,
    index: PageIndex | None = None,
) -> DataFrame:
    """One page of rows in source order, counted from 1; a page past the end is empty.

    Rows of equal order follow in the order of a hash of the whole row, so pages neither overlap nor
    leave out rows. Only the ranges that hold the page are read, hashed and sorted (see
    ``page_index``); without an index the first pages take the least rows of the table instead.
    """
    if number < 1:
        raise ValueError("Pages are counted from 1.")
    offset = (number - 1) * page_rows
    order = source.order_columns()
    if index is None and offset + page_rows <= SHALLOW_ROWS:
        return source.to_df(columns, with_tie(source).orderBy(*order, "_tie").offset(offset).limit(page_rows))
    return _page_by_index(source, index or page_index(source), offset, page_rows, columns)


def with_tie(source: Table) -> DataFrame:
    """The rows with ``_tie``, a hash of all columns that tells rows of equal order apart."""
    # Maps have no hash, their text form has.
    whole = F.struct(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in source.df.schema.fields])
    return source.df.select("*", F.xxhash64(whole).alias("_tie"))


def number_rows(source: Table) -> DataFrame:
    """Row positions (1, 2, ...) beside the order columns and a row hash. Keep it to open many deep pages."""
    order = source.order_columns()
    keys = with_tie(source).select(*[column.alias(f"order{i}") for i, column in enumerate(order)], F.col("_tie").alias("tie"))
    order_keys = [F.col(name) for name in keys.columns]
    return with_running_total(keys, order_keys, name="row_number").drop("grand_total")


def page_of_numbered(
    source: Table,
    numbered: DataFrame,
    number: int,
    page_rows: int = PAGE_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    offset = (number - 1) * page_rows
    wanted = numbered.where(F.col("row_number").between(offset + 1, offset + page_rows))
    order = source.order_columns()
    keys = [*(f"order{i}" for i in range(len(order))), "tie"]
    same = [column.eqNullSafe(F.col(key)) for column, key in zip([*order, F.col("_tie")], keys, strict=True)]
    # At most page_rows keys. Rows with equal keys are equal: one stands for all of them.
    rows = with_tie(source).join(F.broadcast(wanted.select(*keys).distinct()), reduce(Column.__and__, same), "inner")
    rows = rows.dropDuplicates(keys).withColumnsRenamed({key: f"found_{key}" for key in keys})
    placed = [F.col(f"found_{key}").eqNullSafe(F.col(key)) for key in keys]
    return source.to_df(columns, rows.join(F.broadcast(wanted), reduce(Column.__and__, placed), "inner").orderBy("row_number"))


def row_total(source: Table) -> DataFrame:
    return source.df.agg(F.count(F.lit(1)).alias("total_rows"))
