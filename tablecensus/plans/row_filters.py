"""Filters on rows and on summary entries: contains, exact, missing."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


class RowFilterError(ValueError):
    """A column filter is malformed or names an unknown column."""


@dataclass(frozen=True)
class Contains:
    value: str


@dataclass(frozen=True)
class Exact:
    value: str


@dataclass(frozen=True)
class Missing:
    pass


ColumnFilter = Contains | Exact | Missing


def parse_filters(document: Mapping[str, object] | None) -> dict[str, ColumnFilter]:
    """Read ``{"column": {"kind": "contains", "value": "x"}}``; filter objects pass through."""
    if document is None:
        return {}
    if not isinstance(document, Mapping):
        raise RowFilterError("Filters must be given per column.")
    return {column: _parse_filter(column, entry) for column, entry in document.items()}


def _parse_filter(column: object, entry: object) -> ColumnFilter:
    if not isinstance(column, str):
        raise RowFilterError("A filter needs a column name.")
    if isinstance(entry, Missing):
        return entry
    if isinstance(entry, (Contains, Exact)):
        entry = {"kind": type(entry).__name__.lower(), "value": entry.value}
    if not isinstance(entry, Mapping):
        raise RowFilterError(f"The filter on {column!r} is not valid.")
    match dict(entry):
        case {"kind": "missing", **rest} if not rest:
            return Missing()
        case {"kind": ("contains" | "exact") as kind, "value": value, **rest} if not rest:
            if not isinstance(value, str) or not value:
                raise RowFilterError(f"The filter on {column!r} needs a text to look for.")
            return Contains(value) if kind == "contains" else Exact(value)
    raise RowFilterError(f"The filter on {column!r} is not valid.")
