"""A DataFrame together with its display names, missing-value markers and source order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.missing import is_missing, is_missing_text, normalize_markers, status
from .plans.selection import ColumnSelectionError, unique_names

ROW_ID = "_row_id"
# Types whose text form always shows a character, so only NULL or a marker makes them missing.
NEVER_BLANK = (T.NumericType, T.BooleanType, T.DatetimeType)


class MissingMarkerError(ValueError):
    """Markers were configured for a column that does not exist."""


class NoInputRowsError(ValueError):
    """The table has columns but no rows."""


def physical(position: int) -> str:
    return f"f{position}"


@dataclass(frozen=True)
class Table:
    """Columns are addressed by position inside Spark.

    Display names may be empty, repeat in another case or hold dots and backticks, so they never
    reach Spark's name resolution. ``order`` lists the columns that give the source order.
    """

    df: DataFrame
    names: tuple[str, ...]
    markers: Mapping[str, frozenset[str]]
    order: tuple[str, ...] = ()

    def position(self, name: str) -> int:
        try:
            return self.names.index(name)
        except ValueError:
            raise ColumnSelectionError(f"The column {name!r} does not exist.") from None

    def raw(self, name: str) -> Column:
        return F.col(physical(self.position(name)))

    def _type(self, name: str) -> T.DataType:
        return self.df.schema[physical(self.position(name))].dataType

    def text(self, name: str) -> Column:
        column = self.raw(name)
        return column if isinstance(self._type(name), T.StringType) else column.cast("string")

    def missing(self, name: str) -> Column:
        kind = self._type(name)
        may_be_blank = not isinstance(kind, NEVER_BLANK)
        markers = self.markers.get(name, frozenset())
        typed = not may_be_blank and not markers - {""}
        # Without markers a typed column needs no text form at all.
        return self.raw(name).isNull() if typed else is_missing(self.text(name), markers, may_be_blank)

    def present(self, name: str) -> Column:
        return ~self.missing(name)

    def value(self, name: str) -> Column:
        """The raw text, with every missing value as NULL."""
        return F.when(self.present(name), self.text(name))

    def status(self, name: str) -> Column:
        return status(self.missing(name))

    def is_missing_value(self, name: str, value: str | None) -> bool:
        return is_missing_text(value, self.markers.get(name, frozenset()))

    def order_columns(self) -> list[Column]:
        if not self.order:
            raise ValueError("This needs the source order: read with row ids or pass order_by.")
        return [F.col(name) for name in self.order]

    def where(self, condition: Column) -> Table:
        return replace(self, df=self.df.where(condition))

    def to_df(self, columns: Sequence[str] | None = None, df: DataFrame | None = None) -> DataFrame:
        """A plain DataFrame under the display names."""
        columns = self.names if columns is None else tuple(columns)
        chosen = (self.df if df is None else df).select(*[self.raw(name) for name in columns])
        return chosen.toDF(*columns)


def table(
    df: DataFrame,
    missing_markers: Mapping[str, Sequence[str]] | None = None,
    order_by: Sequence[str] | None = None,
) -> Table:
    """Wrap any DataFrame. A ``_row_id`` column gives the source order unless ``order_by`` does."""
    positions = [i for i, name in enumerate(df.columns) if name != ROW_ID]
    slots = {position: physical(slot) for slot, position in enumerate(positions)}
    positional = df.toDF(*[slots.get(i, ROW_ID) for i in range(len(df.columns))])
    names = unique_names(df.columns[i] for i in positions)
    result = positional_table(positional, names, missing_markers)
    if order_by is not None:
        result = replace(result, order=tuple(physical(result.position(name)) for name in order_by))
    return result


def positional_table(
    df: DataFrame, names: tuple[str, ...], missing_markers: Mapping[str, Sequence[str]] | None = None
) -> Table:
    """A table over ``f0``, ``f1``, ... and an optional ``_row_id``."""
    markers = {name: normalize_markers(given) for name, given in (missing_markers or {}).items()}
    for name in markers:
        if name not in names:
            raise MissingMarkerError(f"Markers are given for an unknown column: {name!r}.")
    return Table(df, names, markers, (ROW_ID,) if ROW_ID in df.columns else ())


def require_rows(source: Table) -> Table:
    """Fail on a table without rows. Looks for one row only."""
    if source.df.isEmpty():
        raise NoInputRowsError("The table has no rows.")
    return source


def by_position(df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """A result DataFrame with positional names, and the names to give back."""
    return df.toDF(*[physical(i) for i in range(len(df.columns))]), tuple(df.columns)


def exact_position(names: Sequence[str], name: str) -> int:
    hits = [i for i, candidate in enumerate(names) if candidate == name]
    if len(hits) != 1:
        raise ColumnSelectionError(f"The column {name!r} does not name exactly one column.")
    return hits[0]
