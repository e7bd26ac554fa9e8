"""Column names and column choices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class ColumnSelectionError(ValueError):
    """A requested column cannot be used."""


def unique_names(raw_names: Iterable[str]) -> tuple[str, ...]:
    """Trim names and number repeats: ``a, a, a`` becomes ``a, a_1, a_2``."""
    names: dict[str, None] = {}
    for raw_name in raw_names:
        base = raw_name.strip()
        name, suffix = base, 0
        while name in names:
            suffix += 1
            name = f"{base}_{suffix}"
        names[name] = None
    return tuple(names)


def unused_name(wanted: str, taken: Sequence[str]) -> str:
    name, suffix = wanted, 0
    while name in taken:
        suffix += 1
        name = f"{wanted}_{suffix}"
    return name


def choose_columns(
    names: Sequence[str], requested: Sequence[str], identifier: str | None = None
) -> tuple[str, ...]:
    """The requested columns in the requested order, without the identifier column."""
    if identifier is not None and identifier not in names:
        raise ColumnSelectionError(f"The identifier column {identifier!r} does not exist.")
    for position, name in enumerate(requested):
        if name not in names:
            raise ColumnSelectionError(f"The column {name!r} does not exist.")
        if name in requested[:position]:
            raise ColumnSelectionError(f"The column {name!r} is selected twice.")
    chosen = tuple(name for name in requested if name != identifier)
    if not chosen:
        raise ColumnSelectionError("At least one column has to be selected.")
    return chosen


def project_columns(names: Sequence[str], analysed: Iterable[str], mode: str = "all") -> tuple[str, ...]:
    """Columns to show beside a row: all, or the analysed ones, always in source order."""
    if mode not in ("all", "analysis"):
        raise ColumnSelectionError(f"Unknown column mode {mode!r}.")
    wanted = set(analysed)
    shown = tuple(name for name in names if name in wanted) if mode == "analysis" else ()
    return shown or tuple(names)
