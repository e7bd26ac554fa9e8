"""Contract documents, value validators and rule counts."""

from copy import deepcopy

import pytest
from pyspark.sql import functions as F

import tablecensus as tc
from tablecensus.functions.validators import is_date, is_datetime, is_integer, is_number
from tablecensus.plans.contract import ContractError


def evaluate(spark, texts, check):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row["r"] for row in df.select("i", check(F.col("t")).alias("r")).orderBy("i").collect()]


INTEGERS = ["1", "+1", "-0", " 12 ", " 7 ", "1\n"]
FRACTIONS = [
    "1.", ".5", "1.5e3", "1E-7", "1e0000000000000000000000000000000005",
    # the widest exponents
    "1e999999999999999999", "10e999999999999999998", "0.1e1000000000000000000", "0.0000000001e1000000000000000009",
    "1e-1999999999999999997", "1.5e-1999999999999999996",
]
NOT_NUMBERS = [
    "e3", ".", "1,000", "NaN", "Infinity", "１２", "٣", "1_0", "", "0x1", "1e", "--1", "1 2",
    "1e1000000000000000000", " 1e1000000000000000000 ", "10e999999999999999999", "0e1000000000000000000",
    "1.5e-1999999999999999997", "1e-1999999999999999998", "1e99999999999999999999999999999999999999999",
]
DATES = ["2024-02-29", " 2024-01-31 ", "0001-01-01", "9999-12-31", "2000-02-29", "2024-01-01\n"]
NOT_DATES = [
    "2023-02-29", "2024-2-09", "0000-01-01", "2024-13-01", "2024-00-10", "2024-01-32", "2024-04-31", "1900-02-29",
    "2024-01-01T", "20240101", "２024-01-01", "2024-01-01 10:00:00", "+2024-01-01",
]
DATETIMES = [
    "2024-02-29 10:20:30", " 2024-01-01 00:00:00", "2024-03-31 02:30:00", "0001-01-01 00:00:00", "1883-11-18 12:03:00",
]
NOT_DATETIMES = [
    "2023-02-29 10:20:30", "2024-01-01 24:00:00", "2024-01-01 23:59:60", "2024-01-01T10:00:00", "2024-01-01 10:00",
    "2024-01-01 10:00:00.5", "0000-01-01 00:00:00", "2024-01-01 10:60:00", "2024-01-01 10:00:00Z",
]


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (is_integer, INTEGERS, FRACTIONS + NOT_NUMBERS),
        (is_number, INTEGERS + FRACTIONS, NOT_NUMBERS),
        (is_date, DATES, NOT_DATES),
        (is_datetime, DATETIMES, NOT_DATETIMES),
    ],
)
def test_validators(spark, check, good, bad):
    assert [t for t, ok in zip(good + bad, evaluate(spark, good + bad, check)) if ok] == good


def test_every_day_of_many_years(spark):
    years = [1, 4, 100, 400, 1582, 1900, 2000, 2023, 2024, 2100, 8888, 9999]
    texts = [f"{y:04}-{m:02}-{d:02}" for y in years for m in range(14) for d in range(33)]
    accepted = [t for t, ok in zip(texts, evaluate(spark, texts, is_date)) if ok]
    leap_years = {4, 400, 2000, 2024, 8888}
    lengths = [(y, m, 29 if m == 2 and y in leap_years else 28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31)
               for y in years for m in range(1, 13)]
    assert accepted == [f"{y:04}-{m:02}-{d:02}" for y, m, n in lengths for d in range(1, n + 1)]


HARVEST = {
    "version": 1,
    "rules": [
        {"column": "weight kg", "kind": "type", "value_type": "number"},
        {"column": "picked", "kind": "type", "value_type": "date", "date_format": "YYYY-MM-DD"},
        {"column": "crates", "kind": "required"},
        {"column": "crates", "kind": "type", "value_type": "integer"},
        {"column": "sort", "kind": "enum", "values": ["Apple", "Pear", "Plum"]},
    ],
}


def test_rule_counts(text_table):
    source = text_table(
        ["sort", "weight kg", "crates", "remark", "picked"],
        [
            ["Apple", "12.25", "3", "x", "2025-09-30"],
            ["Pear", ".5", "-", "", "2025-09-31"],
            ["pear", "heavy", "2.5", "x", ""],
            ["Plum", "?", "", "x", "30.09.2025"],
            ["", " 1e1 ", "+8", "x", "2025-10-01"],
            ["Quince", "", "many", "x", " 2024-02-29 "],
            ["Plum", "7", " - ", "", "2025-11-11"],
        ],
        {"weight kg": ["?"], "crates": ["-"]},
    )
    counts = tc.evaluate_contract(source, HARVEST)
    # rule, rows, missing, passing, failing
    assert [tuple(row) for row in counts.orderBy("rule_index").collect()] == [
        (0, 7, 2, 4, 1),
        (1, 7, 1, 4, 2),
        (2, 7, 3, 4, 3),
        (3, 7, 3, 2, 2),
        (4, 7, 1, 4, 2),
    ]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "f3" not in plan.split("LogicalRDD")[0]


def test_an_empty_table_gives_zero_counts(text_table):
    source = text_table(["sort", "weight kg", "crates", "picked"], [])
    assert {tuple(row)[1:] for row in tc.evaluate_contract(source, HARVEST).collect()} == {(0, 0, 0, 0)}


def broken(change):
    document = deepcopy(HARVEST)
    change(document, document["rules"])
    return document


BREAKS = {
    "no version": lambda d, r: d.pop("version"),
    "no rules": lambda d, r: d.pop("rules"),
    "empty rules": lambda d, r: r.clear(),
    "rules are no list": lambda d, r: d.update(rules={}),
    "rule is no object": lambda d, r: r.append("sort"),
    "more keys": lambda d, r: d.update(name="harvest"),
    **{f"version {v!r}": lambda d, r, v=v: d.update(version=v) for v in (0, 2, True, "1", None, float("nan"))},
    **{f"rule {i} without {key}": lambda d, r, i=i, key=key: r[i].pop(key) for i, rule in enumerate(HARVEST["rules"]) for key in rule},
    **{f"rule {i} with more": lambda d, r, i=i: r[i].update(weight=1) for i in range(5)},
    **{f"rule {i} column no text": lambda d, r, i=i: r[i].update(column=i) for i in range(5)},
    **{f"rule {i} of another kind": lambda d, r, i=i: r[i].update(kind="least") for i in range(5)},
    **{f"type {t!r}": lambda d, r, t=t: r[0].update(value_type=t) for t in ("decimal", ["number"], None)},
    "format of a number": lambda d, r: r[0].update(date_format="YYYY-MM-DD"),
    "another format": lambda d, r: r[1].update(date_format="MM/DD/YYYY"),
    **{f"enum {v!r}": lambda d, r, v=v: r[4].update(values=v) for v in ([], ["Apple", "Apple"], ["Apple", " "], ["Apple", 3])},
}


@pytest.mark.parametrize("name", BREAKS)
def test_a_document_with_one_fault_is_rejected(name):
    tc.parse_contract(HARVEST)
    with pytest.raises(ContractError):
        tc.parse_contract(broken(BREAKS[name]))


@pytest.mark.parametrize("text", ["harvest", "[]", "7"])
def test_text_without_a_document_is_rejected(text):
    with pytest.raises(ContractError):
        tc.parse_contract(text)


def test_a_float_version_one_is_accepted():
    assert tc.parse_contract('{"version": 1.0, "rules": [{"column": "a", "kind": "required"}]}').rules[0].column == "a"


@pytest.mark.parametrize("column", ["b", "A", " a"])
def test_columns_bind_exactly(text_table, column):
    source = text_table(["a", "B"], [["1", "2"]])
    with pytest.raises(ContractError):
        tc.evaluate_contract(source, {"version": 1, "rules": [{"column": column, "kind": "required"}]})
