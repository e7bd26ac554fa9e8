"""What counts as a missing value: NULL, blank text, or a marker configured for the column."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_towards, is_blank, starts_visibly, strip

PRESENT = "present"
MISSING = "missing"


def normalize_markers(markers: Iterable[str]) -> frozenset[str]:
    return frozenset(marker.strip().casefold() for marker in markers)


def is_missing_text(value: str | None, markers: frozenset[str]) -> bool:
    """The same rule for one value on the driver, used to resolve arguments."""
    if value is None:
        return True
    folded = value.strip().casefold()
    return not folded or folded in markers


def is_missing(text: Column, markers: frozenset[str] = frozenset(), may_be_blank: bool = True) -> Column:
    missing = text.isNull()
    if may_be_blank:
        missing = missing | is_blank(text)
    wanted = sorted(markers - {""})
    if wanted:
        # Trimming stands here once only: Spark computes what appears twice for every row in
        # advance, also when the first condition already settles it.
        missing = missing | (_may_be_marker(text, wanted) & fold_towards(strip(text), wanted).isin(wanted))
    return missing


def _may_be_marker(text: Column, wanted: list[str]) -> Column:
    """A value that starts with visible ASCII has to start like a marker."""
    letters = sorted({case for marker in wanted for case in (marker[0], marker[0].upper()) if case.isascii()})
    return reduce(Column.__or__, [text.startswith(letter) for letter in letters], ~starts_visibly(text))


def status(missing: Column) -> Column:
    return F.when(missing, F.lit(MISSING)).otherwise(F.lit(PRESENT))
