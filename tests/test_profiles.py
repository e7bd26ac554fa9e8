"""Profiles, snapshots, typed figures, suggestions and reference checks."""

import math
import random
from collections import Counter
from datetime import date, datetime

import numpy as np
import pytest

import tablecensus as tc
from pyspark.sql import functions as F

from tablecensus.operators import suggestions
from tablecensus.operators.profile import SnapshotError
from tablecensus.sources.row_ids import with_row_position
from tablecensus.operators.ranking import ensure_checkpoint_dir, with_running_total


def tuples(df):
    return [tuple(row) for row in df.collect()]


def test_column_profile(text_table):
    source = text_table(
        ["code", "note"], [["E-1", "x"], ["E-2", ""], ["E-2", "n/a"], ["F-10", ""]], {"note": ["n/a"]}
    )
    assert tuples(tc.column_profile(source).orderBy("column_index")) == [
        (0, "code", 4, 4, 1.0, 0, 0.0, 3, 0.75, "E-2", 2, 0.5, 1, 3),
        (1, "note", 4, 1, 0.25, 3, 0.75, 2, 0.5, "x", 1, 1.0, 0, 0),
    ]


def test_snapshots_compare_columns_and_figures(spark, text_table, tmp_path):
    old = text_table(["a", "b", "gone"], [["1", "x", ""], ["2", "", ""]], {"a": ["-"]})
    new = text_table(["b", "a", "c"], [["x", "1", "1"], ["y", "-", "2"], ["z", "3", "3"]], {"a": ["-"]})
    for name, source in (("old", old), ("new", new)):
        tc.save_snapshot(source, tc.column_profile(source), str(tmp_path / name))
    (before, old_settings), (after, new_settings) = (
        tc.load_snapshot(spark, str(tmp_path / name)) for name in ("old", "new")
    )
    assert not {"top_term", "value"} & set(before.columns)
    result = tc.compare_snapshots(before, after, old_settings, new_settings)
    rows = {row.column_name: row for row in result.collect()}
    assert {name: row.column_change for name, row in rows.items()} == {
        "a": "reordered", "b": "reordered", "gone": "removed", "c": "added",
    }
    assert rows["a"].missing_count_change == 1 and rows["a"].input_rows_change == 1
    assert rows["b"].present_share_change == 0.5
    renamed = tc.compare_snapshots(before, after, old_settings, new_settings, {"gone": "c"})
    assert {row.column_name: row.column_change for row in renamed.collect()}["c"] == "same"
    with pytest.raises(SnapshotError):
        tc.compare_snapshots(before, after, old_settings, tc.snapshot_settings(text_table(["a"], [["1"]])))
    with pytest.raises(SnapshotError):
        tc.compare_snapshots(before, after, old_settings, new_settings.replace('"version": 1', '"version": 9'))


def test_numeric_summary_is_exact(text_table):
    rng = random.Random(1)
    # A third of the rows share one value.
    numbers = [rng.choice([7.0, rng.uniform(-50, 50), rng.randint(-9, 9)]) for _ in range(400)]
    texts = [repr(n) for n in numbers] + ["", "n/a", "abc", "1,0", " 3 "]
    numbers.append(3.0)
    rng.shuffle(texts)
    source = text_table(["v"], [[t] for t in texts], {"v": ["n/a"]})
    quantiles = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    row = tc.value_summary(source, "v", "number", quantiles).head()
    assert tuple(row)[:4] == (405, 2, 401, 2)
    assert row.min_value == min(numbers) and row.max_value == max(numbers)
    expected = np.quantile(np.array(numbers), quantiles)
    assert all(math.isclose(got, want, abs_tol=1e-12) for got, want in zip(tuple(row)[6:], expected))


def test_summaries_without_values(text_table):
    source = text_table(["v"], [["x"], [""]])
    assert tuples(tc.value_summary(source, "v", "integer")) == [(2, 1, 0, 1, None, None, None, None, None)]
    assert tuples(tc.histogram(source, "v", "integer", 3)) == []
    assert tuples(tc.date_counts(source, "v")) == []


def test_date_summary_and_counts(text_table):
    texts = ["2024-01-01", "2024-01-01", "2024-02-29", "2023-12-31", "2023-02-29", "", "2024-01-07"]
    source = text_table(["d"], [[t] for t in texts])
    row = tc.value_summary(source, "d", "YYYY-MM-DD").head()
    assert tuple(row) == (7, 1, 5, 1, date(2023, 12, 31), date(2024, 2, 29), date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 7))
    assert sorted(tuples(tc.date_counts(source, "d", interval="month"))) == [
        (date(2023, 12, 1), 1, 0.2), (date(2024, 1, 1), 3, 0.6), (date(2024, 2, 1), 1, 0.2),
    ]
    assert (date(2024, 1, 1), 3, 0.6) in tuples(tc.date_counts(source, "d", interval="week"))
    stamped = text_table(["d"], [["2024-01-01 10:00:00"], ["2024-01-02 11:00:00"]])
    assert tc.value_summary(stamped, "d", "YYYY-MM-DD HH:MM:SS").head().max_value == datetime(2024, 1, 2, 11)
    with pytest.raises(ValueError):
        tc.date_counts(source, "d", interval="year")


def test_histogram(text_table):
    source = text_table(["v"], [[t] for t in ["0", "1", "2", "9", "10", "x", "", "1e999"]])
    rows = tuples(tc.histogram(source, "v", "number", 5).orderBy("bin"))
    assert [row[3] for row in rows] == [2, 1, 0, 0, 2]
    assert rows[0][1:3] == (0.0, 2.0) and rows[-1][1:3] == (8.0, 10.0) and rows[0][4] == 0.4
    same = text_table(["v"], [["5"], ["5"]])
    assert [row[3] for row in tuples(tc.histogram(same, "v", bins=2).orderBy("bin"))] == [2, 0]


def test_suggestions(text_table):
    source = text_table(["city"], [[t] for t in ["Bonn", "bonn", " BONN ", "Bonn", "Köln", "straße", "STRASSE", "", "x"]])
    rows = sorted(tuples(tc.normalization_suggestions(source)))
    assert rows == [
        (0, "city", " BONN ", 1, "Bonn", 3, 4),
        (0, "city", "Bonn", 2, "Bonn", 3, 4),
        (0, "city", "STRASSE", 1, "STRASSE", 2, 2),
        (0, "city", "bonn", 1, "Bonn", 3, 4),
        (0, "city", "straße", 1, "STRASSE", 2, 2),
    ]
    accepted = tc.normalization_suggestions(source).where("proposed_text = 'Bonn'")
    cleaned = [row.city for row in tc.in_source_order(tc.apply_suggestions(source, accepted, ["city"])).collect()]
    assert cleaned == ["Bonn", "Bonn", "Bonn", "Bonn", "Köln", "straße", "STRASSE", None, "x"]


def test_key_reference_check(text_table):
    left = text_table(["a", "b"], [["1", "x"], ["1", "x"], ["2", "y"], ["", "y"], ["3", ""], ["4", "z"]])
    right = text_table(["k", "l"], [["1", "x"], ["5", "y"], ["4", "z"], ["4", "z"], ["", ""]])
    row = tc.key_reference_check(left, ["a", "b"], right, ["k", "l"]).head()
    assert tuple(row) == (3, 3, 2, 1, 1, 3, 1, 2, 1)
    with pytest.raises(ValueError):
        tc.key_reference_check(left, ["a", "b"], right, ["k"])


def test_running_totals_across_partitions(spark):
    rng = random.Random(2)
    # One key has a third of the weight; order values repeat.
    data = [(rng.randint(0, 50), rng.choice([1, 1, 500])) for _ in range(500)]
    df = spark.createDataFrame(data, "k int, w int").repartition(6)
    counted = df.groupBy("k").sum("w").withColumnRenamed("sum(w)", "w")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = with_running_total(counted, [counted["k"]], "w", "total").orderBy("k").collect()
        positions = with_running_total(df, [df["k"], df["w"]], name="n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    weights = Counter()
    for k, w in data:
        weights[k] += w
    running = 0
    for row in result:
        running += weights[row.k]
        assert (row.total, row.grand_total) == (running, sum(weights.values()))
    assert sorted(row.n for row in positions) == list(range(1, 501))
    by_position = [(row.k, row.w) for row in sorted(positions, key=lambda row: row.n)]
    assert by_position == sorted(data)


def test_the_configured_checkpoint_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    if configured:
        assert configured.rstrip("/") in folder


def test_integer_summary_beyond_doubles(text_table):
    values = ["9007199254740993", "9007199254740992", "-99999999999999999999999999999999999999", "9" * 39, "x", ""]
    row = tc.value_summary(text_table(["v"], [[v] for v in values]), "v", "integer", [0.5, 1.0]).head()
    assert tuple(row)[:4] == (6, 1, 3, 2)
    assert (int(row.min_value), int(row.max_value)) == (-(10**38 - 1), 9007199254740993)
    assert (int(row["q0.5"]), int(row.q1)) == (9007199254740992, 9007199254740993)
    near = tc.value_summary(text_table(["v"], [[v] for v in values[:2]]), "v", "integer", [0.25]).head()
    assert str(near["q0.25"]) == "9007199254740992.250000"


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_TERMS": 1, "FREQUENT_TERMS": 1}])
def test_accepted_suggestions_keep_the_rows(text_table, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suggestions, name, value)
    source = text_table(["a", "b"], [["x", "q"], ["X", "Q"], ["x", "q"], [" x", ""], ["z", "q "]])
    accepted = tc.normalization_suggestions(source)
    cleaned = tc.apply_suggestions(source, accepted.unionAll(accepted), ["a", "b"])
    assert tuples(tc.in_source_order(cleaned)) == [("x", "q"), ("x", "q"), ("x", "q"), ("x", None), ("z", "q")]
    other = accepted.withColumn("proposed_text", F.lit("other"))
    with pytest.raises(ValueError):
        tc.apply_suggestions(source, accepted.unionAll(other), ["a"])


@pytest.mark.parametrize("number", [1, 500])
def test_pages_of_a_table_with_maps(spark, number):
    df = spark.range(20).select("id", F.create_map(F.lit("k"), F.col("id")).alias("m"))
    rows = tc.page(tc.table(df, order_by=["id"]), number, 5 if number == 1 else 1).collect()
    assert [row.m for row in rows] == ([{"k": i} for i in range(5)] if number == 1 else [])
    deep = tc.page_of_numbered(tc.table(df, order_by=["id"]), tc.number_rows(tc.table(df, order_by=["id"])), 2, 5).collect()
    assert [row.m for row in deep] == [{"k": i} for i in range(5, 10)]


def test_row_positions_over_several_files(spark, tmp_path):
    spark.range(1000).repartition(4).write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    first = {row.row_position: row.id for row in with_row_position(df).collect()}
    assert sorted(first) == list(range(1000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        again = {row.row_position: row.id for row in with_row_position(spark.read.parquet(str(tmp_path / "rows"))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == first


def test_summary_filter_on_a_number_and_level_of_nothing(text_table):
    terms = tc.formal_terms(text_table(["v"], [["a"], ["a"], ["b"]]), ["v"])
    assert [row.value for row in tc.filter_summary(terms, {"count": {"kind": "exact", "value": "2"}}).collect()] == ["a"]
    empty = tc.with_level(tc.column_completeness(text_table(["v"], [])))
    assert [row.level for row in empty.collect()] == [None]
