"""Checks that a text value is an integer, a number, a date or a date with time.

The values stay text. Every check trims first and then needs the whole text to fit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, whitespace

# Surrounding whitespace is part of the pattern, so only values of the right shape get trimmed.
BLANKS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in whitespace()) + "]*+"
INTEGER = r"[+-]?[0-9]+"
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
HUGE_EXPONENT = r"[^eE]*[eE][+-]?0*[1-9][0-9]{17,}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATETIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"

# The exponent range of the decimal arithmetic whose acceptance is matched.
LARGEST_EXPONENT = 999999999999999999
SMALLEST_EXPONENT = -1999999999999999997


def _has_shape(text: Column, shape: str) -> Column:
    return text.rlike(rf"\A{BLANKS}(?:{shape}){BLANKS}\z")


def is_integer(text: Column) -> Column:
    return _has_shape(text, INTEGER)


def is_number(text: Column) -> Column:
    return (
        F.when(~_has_shape(text, NUMBER), F.lit(False))
        .when(_has_shape(text, HUGE_EXPONENT), _exponent_in_range(strip(text)))
        .otherwise(F.lit(True))
    )


def _exponent_in_range(trimmed: Column) -> Column:
    sign = F.when(trimmed.rlike(r"[eE]-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    written = F.regexp_extract(trimmed, r"[eE][+-]?0*([1-9][0-9]*)\z", 1)
    exponent = sign * F.substring(written, 1, 25).try_cast("decimal(25,0)")
    fraction = F.length(F.regexp_extract(trimmed, r"\.([0-9]*)", 1))
    coefficient = F.replace(F.regexp_extract(trimmed, r"\A[+-]?([0-9.]*)", 1), F.lit("."), F.lit(""))
    digits = F.greatest(F.length(F.ltrim(coefficient, F.lit("0"))), F.lit(1))
    last = exponent - fraction
    return (
        (F.length(written) <= 25)
        & (last >= F.lit(SMALLEST_EXPONENT))
        & (last + digits - F.lit(1) <= F.lit(LARGEST_EXPONENT))
    )


def _is_calendar(text: Column, shape: str, spark_type: str) -> Column:
    trimmed = strip(text)
    # There is no year 0.
    real = ~trimmed.startswith("0000") & trimmed.try_cast(spark_type).isNotNull()
    return F.when(_has_shape(text, shape), real).otherwise(F.lit(False))


def is_date(text: Column) -> Column:
    return _is_calendar(text, DATE, "date")


def is_datetime(text: Column) -> Column:
    # Without a time zone no hour of the calendar is left out.
    return _is_calendar(text, DATETIME, "timestamp_ntz")
