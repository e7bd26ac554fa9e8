"""Transformation rules against Python's own string and regex behaviour."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablecensus.functions.pyregex import portable_regex
from tablecensus.operators.transforms import (
    DATE_TEXT,
    TIME_TEXT,
    preview_statistics,
    transform,
    transform_preview,
    transform_statistics,
)
from tablecensus.plans.transform_rules import TransformRuleError, parse_rule

PORTABLE = [
    r"(\d+)-(\w+)",
    r"^([A-Z]{2,3})_?(\d*)",
    r"(?P<year>\d{4})(?:-(\d\d))?",
    r"\bфу(\w)\b",
    r"a.c$",
    r"[^\s,;]+",
    r"(foo|ba[rz])x?",
    r"(?<=#)(\w+)(?!\w)",
    r"(a)\1",
    r"\s(\S)",
    r"x{2,3}?",
    r"[]\-a^]+",
    r"[\w.]+@[\w.]+",
    r"(.*?),",
    r"(?s)a.b",
    r"\Bb\B",
    r"^$|z\Z",
]
LEFT_TO_PYTHON = [r"(?i)abc", r"(a)?(?(1)b|c)", r"(?:ab|c)*", r"(?:a*){2}", r"(?a)\d", r"(?m)^b"]
ALPHABET = "aAbBcCfoxyz019_-., \t\n\r\x1c\x85 #@éßфу²½٣́"


def random_texts(count=300):
    rng = random.Random(11)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 14))) for _ in range(count)]
    return texts + ["foobarx", "2024-05", "AB_12", "a.c\n", "abc", "a\nb", "aa", "x@y.z", "фуя", "z\n", "xxx"]


def evaluate(spark, texts, *expressions):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    columns = [e(F.col("t")).alias(f"r{n}") for n, e in enumerate(expressions)]
    rows = df.select("i", *columns).orderBy("i").collect()
    return [tuple(row)[1:] for row in rows]


@pytest.mark.parametrize("pattern", [*PORTABLE, DATE_TEXT, TIME_TEXT])
def test_java_form_matches_the_same_text(spark, pattern):
    java = portable_regex(pattern).java
    texts = random_texts()
    found = evaluate(spark, texts, lambda c: c.rlike(java), lambda c: F.regexp_extract(c, java, 0))
    hits = [re.search(pattern, text) for text in texts]
    assert found == [(hit is not None, hit.group(0) if hit else "") for hit in hits]


@pytest.mark.parametrize("pattern", LEFT_TO_PYTHON)
def test_other_patterns_have_no_java_form(pattern):
    assert portable_regex(pattern) is None


@pytest.mark.parametrize("pattern", [*PORTABLE, *LEFT_TO_PYTHON, r"(a)?b", r"(a*)?b", r"(x*)", "(", ""])
def test_regex_extract(text_table, pattern):
    texts = random_texts(60) + ["   ", None, "b", "ab"]
    groups = (0, 1, 2, 9)
    rules = [
        {
            "source_column": "t",
            "target_column": f"group{group}",
            "transform_type": "regex_extract",
            "config": {"pattern": pattern, "group": group},
        }
        for group in groups
    ]

    def expected(text, group):
        if text is None or not text.strip():
            return text, None
        try:
            hit = re.search(pattern, text) if pattern else None
        except re.error:
            hit = None
        if hit is None:
            return text, False
        return hit.group(group if group <= hit.re.groups else 0), True

    source = text_table(["t"], [[text] for text in texts])
    result = transform(source, rules).to_df().collect()
    stats = transform_statistics(source, rules).orderBy("rule_index").collect()
    for group, counts in zip(groups, stats):
        wanted = [expected(text, group) for text in texts]
        assert [row[f"group{group}"] for row in result] == [value for value, _ in wanted]
        flags = [flag for _, flag in wanted]
        assert tuple(counts)[2:] == (flags.count(True), flags.count(False), flags.count(None), len(texts))


def apply_one(text_table, texts, transform_type, config):
    rule = {"source_column": "t", "target_mode": "overwrite", "transform_type": transform_type, "config": config}
    source = text_table(["t"], [[text] for text in texts])
    stats = transform_statistics(source, [rule]).head()
    return [row["t"] for row in transform(source, [rule]).to_df().collect()], stats


SPLIT_TEXTS = ["ORD_77_x", "_a_", "none", "a__b", "___", "é_ü", " _ "]


@pytest.mark.parametrize(
    "config, expected",
    [
        ({"delimiter": "_", "position": "before"}, lambda t: t.split("_", 1)[0]),
        ({"delimiter": "_", "position": "before_first"}, lambda t: t.split("_", 1)[0]),
        ({"delimiter": "_"}, lambda t: t.split("_", 1)[1]),
        ({"delimiter": "_", "position": "after_last"}, lambda t: t.rsplit("_", 1)[-1]),
        ({"delimiter": "__", "position": "after_last"}, lambda t: t.rsplit("__", 1)[-1]),
        ({"delimiter": "_", "position": "part_index", "part_index": 2}, lambda t: t.split("_")[1]),
        ({"delimiter": "_", "position": "part_index", "part_index": "3"}, lambda t: t.split("_")[2]),
        ({"delimiter": "_", "position": "part_index", "part_index": 0}, lambda t: t.split("_")[99]),
        ({"delimiter": "", "position": "after"}, lambda t: [][0]),
        ({"delimiter": "_", "position": "sideways"}, lambda t: [][0]),
    ],
)
def test_delimiter_split(text_table, config, expected):
    def wanted(text):
        if config["delimiter"] not in text:
            return text
        try:
            return expected(text)
        except IndexError:
            return text

    result, _ = apply_one(text_table, SPLIT_TEXTS, "delimiter_split", config)
    assert result == [wanted(text) for text in SPLIT_TEXTS]


def test_part_index_out_of_range_is_unmatched(text_table):
    config = {"delimiter": "_", "position": "part_index", "part_index": 3}
    result, stats = apply_one(text_table, ["a_b", "a_b_c", "x", ""], "delimiter_split", config)
    assert result == ["a_b", "c", "x", None]
    assert (stats.matched_count, stats.unmatched_count, stats.empty_count) == (1, 2, 1)


@pytest.mark.parametrize(
    "config, expected",
    [
        ({}, lambda t: t[:5]),
        ({"mode": "first_n", "count": 0}, lambda t: t[:0]),
        ({"mode": "first_n", "count": -2}, lambda t: t[:-2]),
        ({"mode": "last_n", "count": 3}, lambda t: t[-3:]),
        ({"mode": "last_n", "count": 0}, lambda t: t),
        ({"mode": "last_n", "count": -1}, lambda t: t),
        ({"mode": "range", "start": 1, "length": 2}, lambda t: t[1:3]),
        ({"mode": "range", "start": -4, "length": 2}, lambda t: t[-4:-2]),
        ({"mode": "range", "start": -3, "length": 5}, lambda t: t[-3:2]),
        ({"mode": "range", "start": 2, "length": 0}, lambda t: t[2:]),
        ({"mode": "range", "start": 10**12, "length": 10**12}, lambda t: t[10**12 :]),
        ({"mode": "other"}, lambda t: t),
    ],
)
def test_substring(text_table, config, expected):
    texts = ["a", "abcdef", "äöü€𝄞xyz", "12"]
    assert apply_one(text_table, texts, "substring", config)[0] == [expected(t) for t in texts]


def test_date_and_time_parts(text_table):
    texts = [
        "13/06/26: 14:30:00",
        "2026-06-13 08:15",
        "2026.06.13T23:59:59.123Z",
        "at 7:05z sharp",
        "day 3: morning",
        "x:9",
        "no digits here",
        "²: x",
        "2026-06-13T10:00:00+02:00",
        "  ",
        "12345-1-1",
    ]
    dates, _ = apply_one(text_table, texts, "date_truncate", {})
    assert dates == [
        "13/06/26",
        "2026-06-13",
        # The T after the date is no word boundary, so the text before the colon is taken.
        "2026.06.13T23",
        "at 7",
        "day 3",
        "x:9",
        "no digits here",
        "²",
        "2026-06-13T10",
        "  ",
        "12345-1-1",
    ]
    times, stats = apply_one(text_table, texts, "date_truncate", {"part": "time_only"})
    assert times == [
        "14:30:00",
        "08:15",
        # A letter before the hour is no word boundary, so the search starts inside it.
        "59:59.123Z",
        "7:05z",
        "3: morning",
        "9",
        "no digits here",
        "²: x",
        "00:00+02:00",
        "  ",
        "12345-1-1",
    ]
    assert (stats.matched_count, stats.unmatched_count, stats.empty_count) == (7, 3, 1)
    split, _ = apply_one(text_table, texts[:3], "date_truncate", {"part": "time_only", "delimiter": ":"})
    assert split == ["14:30:00", "15", "59:59.123Z"]
    head, _ = apply_one(text_table, texts[:3], "date_truncate", {"delimiter": ":"})
    assert head == ["13/06/26", "2026-06-13 08", "2026.06.13T23"]


def test_case_and_trim(text_table):
    texts = [" o'neil SMITH ", "x", "  "]
    cases = {"upper": str.upper, "lower": str.lower, "title": str.title, "none": str}
    for case, method in cases.items():
        expected = [method(texts[0].strip()), method("x"), "  "]
        assert apply_one(text_table, texts, "case_trim", {"case": case})[0] == expected
    assert apply_one(text_table, texts, "case_trim", {"trim": False, "case": "upper"})[0][0] == texts[0].upper()


def test_rules_run_in_order_and_names_stay_unique(text_table):
    sightings = [["a", "2026.03.01|08:15", "hall_7"], ["b", "2026.03.02|x", "hall_12"], ["c", "2026.03.05|", "yard"], ["d", "none", "gate_30"]]
    source = text_table(["sku", "seen", "place"], sightings)
    rules = [
        {"id": "day", "source_column": "seen", "target_column": "place", "transform_type": "date_truncate",
         "config": {"delimiter": "|"}},
        {"source_column": "place", "target_mode": "overwrite", "transform_type": "delimiter_split"},
        {"source_column": "place_1", "transform_type": "substring", "config": {"count": 2}},
        {"source_column": "absent", "transform_type": "case_trim"},
    ]
    result = transform(source, rules)
    assert result.names == ("sku", "seen", "place", "place_1", "place_1_transformed")
    changed = [tuple(row)[2:] for row in result.to_df().orderBy("sku").collect()]
    assert changed == [("7", "2026.03.01", "20"), ("12", "2026.03.02", "20"), ("yard", "2026.03.05", "20"), ("30", "none", "no")]
    stats = [tuple(row) for row in transform_statistics(source, rules).collect()]
    assert stats == [
        (0, "day", 3, 1, 0, 4),
        (1, "rule_place", 3, 1, 0, 4),
        (2, "rule_place_1", 4, 0, 0, 4),
        (3, "rule_absent", 0, 0, 0, 4),
    ]


def test_preview_shows_both_sides_of_the_first_rows(text_table):
    source = text_table(["a"], [[f"x_{i}"] for i in range(40)])
    rules = [{"source_column": "a", "target_mode": "overwrite"}]
    preview = transform_preview(source, rules)
    assert preview.columns == ["original_a", "transformed_a"]
    assert [tuple(row) for row in preview.collect()] == [(f"x_{i}", str(i)) for i in range(25)]
    assert preview_statistics(source, rules).head()["total_rows"] == 25


def test_malformed_rules():
    for document in [{}, {"source_column": "a", "target_mode": "replace"},
                     {"source_column": "a", "transform_type": "substring", "config": {"count": "many"}}]:
        with pytest.raises(TransformRuleError):
            parse_rule(document)
