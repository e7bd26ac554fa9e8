"""Native text functions against Python's own string methods."""

import math
import random
import struct
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecensus.functions.missing import is_missing, is_missing_text, normalize_markers
from tablecensus.functions.text import (
    double_text,
    casefold,
    fold_towards,
    contains_casefolded,
    shorten,
    slice_text,
    strip,
    structural_format,
    title,
    whitespace,
)
from tablecensus.sinks.csv import inert_name, inert_text


def evaluate(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", expression(F.col("t")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def every_character():
    return [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def mixed_texts(count=400):
    rng = random.Random(7)
    alphabet = "aAzZ09 \t 　\x1cßẞİıſKéÉΣςσǆﬀﬁŉ'-_.,\"<>5digits"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(count)]


def test_casefold_of_every_character(spark):
    texts = every_character()
    assert evaluate(spark, texts, casefold) == [t.casefold() for t in texts]


def test_strip_of_every_character(spark):
    texts = [f"{c}x{c}" for c in every_character()]
    assert evaluate(spark, texts, strip) == [t.strip() for t in texts]
    assert len(whitespace()) == 29


def test_casefold_and_strip_of_mixed_texts(spark):
    texts = mixed_texts()
    assert evaluate(spark, texts, casefold) == [t.casefold() for t in texts]
    assert evaluate(spark, texts, strip) == [t.strip() for t in texts]


@pytest.mark.parametrize("needle", ["STRASSE", "ss", "s", "fi", "n/a", "k", "ŉ", "i̇"])
def test_contains_ignores_case_like_casefold(spark, needle):
    texts = mixed_texts() + ["Straße", "MASSE", "oﬃce", None, "N/A", "Kelvin"]
    expected = [t is not None and needle.casefold() in t.casefold() for t in texts]
    assert evaluate(spark, texts, lambda c: contains_casefolded(c, needle)) == expected


@pytest.mark.parametrize("markers", [[], ["n/a"], ["  n/A  ", "-"], ["MISSING", "ss"], ["ﬁ"], ["", "İ"]])
def test_missing_rule(spark, markers):
    folded = normalize_markers(markers)
    texts = mixed_texts() + [None, "", "   ", "  ", " N/A ", "n/a", "0", "-", "mißing", "fi", "FI", "Ss", "ß"]
    texts += ["i̇", "İ"]
    expected = [is_missing_text(t, folded) for t in texts]
    assert evaluate(spark, texts, lambda c: is_missing(c, folded)) == expected


def test_targeted_folding_agrees_on_equality(spark):
    texts = mixed_texts()
    target = "ss"
    folded = evaluate(spark, texts, lambda c: fold_towards(c, [target]) == target)
    assert folded == [t.casefold() == target for t in texts]


def test_structural_format(spark):
    cases = {
        "EMP-00123": "EMP-<5 digits>",
        "A1B22": "A<1 digits>B<2 digits>",
        "none": None,
        "": None,
        "１２": None,
        "7": "<1 digits>",
        "<5 digits>": "<<1 digits> digits>",
        "line\n12": "line\n<2 digits>",
        None: None,
    }
    assert evaluate(spark, list(cases), structural_format) == list(cases.values())


def test_title_follows_python(spark):
    texts = ["o'neil smith", "HELLO wORLD", "a1b2 c", "élan VITAL", "x_y-z", "", "ßtraße", "they're BILL's"]
    assert evaluate(spark, texts, title) == [t.title() for t in texts]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.integers(-9, 9)))
def test_slices_follow_python(spark, start, stop):
    texts = ["", "a", "abc", "äöü€𝄞xyz", "0123456789"]
    expected = [t[start:stop] for t in texts]
    assert evaluate(spark, texts, lambda c: slice_text(c, start, stop)) == expected


def test_shorten(spark):
    texts = ["x" * 256, "y" * 257, None, "short"]
    assert evaluate(spark, texts, shorten) == ["x" * 256, "y" * 256 + "...", None, "short"]


def test_inert_text(spark):
    texts = ["=1+1", " =1+1", "+a", "-a", "@a", "\ta", "\ra", "a=1", "", None, " =1", " a", "'=1", "\n-1"]

    def expected(text):
        if text is None:
            return None
        risky = text.startswith(("=", "+", "-", "@", "\t", "\r")) or text.lstrip().startswith(("=", "+", "-", "@"))
        return "'" + text if risky else text

    assert evaluate(spark, texts, inert_text) == [expected(t) for t in texts]
    assert [inert_name(t) for t in texts if t] == [expected(t) for t in texts if t]


def test_doubles_are_written_like_python_writes_them(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1.0, 0.1, 1 / 3, 100.0, 1e15, 1e16, 123456789012345680.0, 1e22, 2e23, 1e-4, 1e-5, -2.5e-7, 5e-324, 2.2250738585072014e-308]
    values += [float("inf"), float("-inf"), 1.7976931348623157e308, *(2.0**k for k in range(-1074, 1024)), *(k * 5e-324 for k in range(1, 200))]
    values += [r.randrange(1, 10**6) / r.randrange(1, 10**6) for _ in range(20_000)]
    values += [x for x in struct.unpack("20000d", r.randbytes(160_000)) if math.isfinite(x)]
    rows = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "x double").select("x", double_text(F.col("x")).alias("t"))
    pairs = [(None if row.x is None or math.isnan(row.x) else repr(row.x), row.t) for row in rows.collect()]
    other = [(want, got) for want, got in pairs if want != got]
    # Another last digit of the same double.
    assert all(got and len(want) == len(got) and float(want) == float(got) for want, got in other), other
    assert len(other) < 10
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
