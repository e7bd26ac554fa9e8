"""Completeness, patterns, terms, groups and the rows behind them on small fixtures."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tablecensus as tc
from tablecensus.functions.missing import is_missing_text, normalize_markers
from tablecensus.operators.details import format_regex
from tablecensus.plans.row_filters import RowFilterError
from tablecensus.plans.selection import ColumnSelectionError, choose_columns, project_columns, unique_names
from tablecensus.table import MissingMarkerError


def tuples(df):
    return [tuple(row) for row in df.collect()]


@pytest.fixture
def parcels(text_table):
    return text_table(
        ["parcel", "sender", "weight", "note"],
        [
            ["1", "Oslo", "12", ""],
            ["2", "", "unknown", "fragile"],
            ["3", "Turin", " UNKNOWN ", "none"],
            ["4", " ", "7", ""],
            ["5", "Oslo", "7", "cold"],
            ["6", "Lima", "", "fragile"],
            ["7", "Oslo", "31", " "],
            ["7", "Turin", "7", "fragile"],
        ],
        {"weight": ["unknown"], "note": ["none"]},
    )


def test_header_names():
    assert unique_names([" a ", "a", "a_1", "", "", "A"]) == ("a", "a_1", "a_1_1", "", "_1", "A")


def test_column_choice():
    assert choose_columns(["a", "b", "c"], ["c", "a"], "a") == ("c",)
    for requested, identifier in [([], None), (["a", "a"], None), (["x"], None), (["a"], "a"), (["a"], "x")]:
        with pytest.raises(ColumnSelectionError):
            choose_columns(["a", "b"], requested, identifier)
    assert project_columns(["a", "b", "c"], ["c", "a"], "analysis") == ("a", "c")
    assert project_columns(["a", "b"], ["x"], "analysis") == ("a", "b")
    assert project_columns(["a", "b"], ["b"]) == ("a", "b")


def test_markers_need_known_columns(spark):
    with pytest.raises(MissingMarkerError):
        tc.table(spark.range(1), {"ID": ["x"]})


def test_column_completeness(parcels):
    completeness = tc.column_completeness(parcels)
    assert tuples(completeness) == [
        (0, "parcel", 8, 8, 1.0, 0, 0.0),
        (1, "sender", 8, 6, 0.75, 2, 0.25),
        (2, "weight", 8, 5, 0.625, 3, 0.375),
        (3, "note", 8, 4, 0.5, 4, 0.5),
    ]
    assert tuple(tc.dataset_health(completeness).head()) == (32, 23, 9, 23 / 32, 3)
    assert [row.level for row in tc.with_level(completeness).collect()] == ["high", "moderate", "moderate", "moderate"]
    order = [row.column_name for row in tc.order_columns(completeness, "missing").collect()]
    assert order == ["note", "weight", "sender", "parcel"]


def test_level_rounds_halves_up(spark):
    df = spark.createDataFrame([(0.494,), (0.495,), (0.894,), (0.895,), (1.0,)], "present_share double")
    assert [row.level for row in tc.with_level(df).collect()] == ["low", "moderate", "moderate", "high", "high"]


def test_empty_table(text_table):
    source = text_table(["a", "b"], [])
    assert tuples(tc.column_completeness(source))[0] == (0, "a", 0, 0, None, 0, None)
    assert tuples(tc.dataset_health(tc.column_completeness(source))) == [(0, 0, 0, 1.0, 0)]
    assert tuples(tc.completeness_patterns(source)) == []
    assert tuples(tc.key_uniqueness(source, ["a"])) == [(0, 0, 0, 0, None)]
    counts = tc.pattern_counts(source)
    assert tuples(tc.completeness_from_counts(counts, source))[1][:4] == (1, "b", 0, 0)


def test_patterns_in_canonical_order(parcels):
    patterns = tc.completeness_patterns(parcels, ["sender", "weight"], "parcel")
    assert tuples(tc.canonical_order(patterns, ["sender", "weight"])) == [
        ("present", "present", 4, 0.5),
        ("present", "missing", 2, 0.25),
        ("missing", "missing", 1, 0.125),
        ("missing", "present", 1, 0.125),
    ]
    kept = tc.filter_patterns(patterns, {"sender": "any", "weight": "missing"})
    assert sorted(row["count"] for row in kept.collect()) == [1, 2]
    assert tuples(tc.top_entries(patterns, ["sender", "weight"], limit=1))[0][:2] == ("present", "present")


def test_more_columns_than_bits(text_table):
    rng = random.Random(5)
    names = [f"c{i}" for i in range(130)]
    rows = [[rng.choice(["", "x"]) for _ in names] for _ in range(20)] * 2
    source = text_table(names, rows)
    with pytest.raises(ColumnSelectionError):
        tc.completeness_patterns(source)
    result = {row[:-2]: row[-2] for row in tuples(tc.completeness_patterns(source, allow_wide=True))}
    expected = Counter(tuple("present" if cell else "missing" for cell in row) for row in rows)
    assert result == dict(expected)
    counts = tc.pattern_counts(source, names[:64], allow_wide=True)
    completeness = tuples(tc.completeness_from_counts(counts, source, names[:64], allow_wide=True))
    assert completeness == tuples(tc.column_completeness(source))


def test_awkward_column_names(text_table):
    names = ["a.b", "A.B", "`x`", "", "count", "share", "o'k"]
    source = text_table(names, [["1", "", "3", "4", "5", "6", "7"]])
    result = tc.completeness_patterns(source)
    assert result.columns == [*names, "count", "share"]
    assert tuples(result)[0][:2] == ("present", "missing")
    assert tuples(tc.group_data(source, ["A.B", "a.b"])) == [(None, "1", 1, 1.0)]
    assert len(tuples(tc.formal_terms(source))) == 7
    assert [row.column_name for row in tc.column_completeness(source).collect()] == names


def test_preview_keeps_first_rows_in_source_order(text_table):
    rows = [[str(i), "x" * 300 if i == 0 else f"v{i}", ""] for i in range(8)] + [["8", "n/a", "y"]]
    source = text_table(["id", "email", "phone"], rows, {"email": ["n/a"]})
    spread = tc.Table(source.df.repartition(4), source.names, source.markers, source.order)
    preview = tuples(tc.pattern_preview(spread, ["email", "phone"], "id").orderBy("preview_rank", "status_email"))
    first = [row for row in preview if row[0] == "present"]
    assert [row[2:] for row in first] == [
        (1, "0", "x" * 256 + "...", None),
        *[(i + 1, str(i), f"v{i}", None) for i in range(1, 5)],
    ]
    assert [row for row in preview if row[0] == "missing"] == [("missing", "present", 1, "8", "n/a", "y")]


def rows_within_limits(patterns, per_pattern, first_limit, extra_limit):
    """The first row of as many patterns as allowed, then further rows of these patterns by position."""
    places = {p: [i for i, q in enumerate(patterns) if q == p][:per_pattern] for p in set(patterns)}
    shown = sorted(places.values())[:first_limit]
    further = sorted(i for rows in shown for i in rows[1:])
    return sorted([rows[0] for rows in shown] + further[:extra_limit])


@pytest.mark.parametrize("first_limit, extra_limit", [(3, 4), (100, 5), (5, 100), (0, 10), (10, 0)])
def test_preview_limits(text_table, first_limit, extra_limit):
    rng = random.Random(first_limit + extra_limit)
    rows = [[str(i), *[rng.choice(["", "x"]) for _ in range(3)]] for i in range(60)]
    source = text_table(["id", "a", "b", "c"], rows)
    preview = tc.pattern_preview(
        source, ["a", "b", "c"], "id", first_rows_limit=first_limit, extra_rows_limit=extra_limit
    )
    kept = sorted(int(row.identifier_value) for row in preview.collect())
    assert kept == rows_within_limits([tuple(map(bool, r[1:])) for r in rows], 5, first_limit, extra_limit)


def test_terms_formats_and_top(text_table):
    source = text_table(
        ["batch", "Code"],
        [["LOT/117", "A"], ["LOT/118", " A "], ["LOT/118", "a"], ["n/a", "LOT/9"], ["", "A"]],
        {"batch": ["n/a"]},
    )
    terms = tc.canonical_order(tc.formal_terms(source, ["batch"]), ["value"])
    assert tuples(terms) == [
        (0, "batch", None, 2, 0.4),
        (0, "batch", "LOT/118", 2, 0.4),
        (0, "batch", "LOT/117", 1, 0.2),
    ]
    assert tuples(tc.structural_formats(source)) == [(0, "batch", "LOT/<3 digits>", 3, 2, 0.6)]
    top = tc.top_terms(source, ["batch", "Code"], limit=1).orderBy("column_index")
    assert tuples(top) == [
        (0, "batch", 1, "LOT/118", 2, 0.4, 2 / 3),
        (1, "Code", 1, "A", 2, 0.4, 0.4),
    ]
    distinct = tc.distinct_terms(source).orderBy("column_index")
    assert [row.distinct_term_count for row in distinct.collect()] == [3, 4]


def test_group_data_and_uniqueness(text_table):
    stops = [["1", "Red", "A"], ["2", "Red", ""], ["3", "Red", "A"], ["4", "blue", " "], ["5", "", "A"], ["6", "Red", "B"], ["7", "VOID", "A"]]
    source = text_table(["stop", "line", "zone"], stops, {"line": ["void"]})
    groups = tc.canonical_order(tc.group_data(source, ["line", "zone"]), ["line", "zone"])
    assert tuples(groups) == [
        (None, "A", 2, 2 / 7),
        ("Red", "A", 2, 2 / 7),
        ("Red", None, 1, 1 / 7),
        ("Red", "B", 1, 1 / 7),
        ("blue", None, 1, 1 / 7),
    ]
    assert tuples(tc.key_uniqueness(source, ["line", "zone"])) == [(5, 3, 2, 4, 3 / 5)]


def test_summary_sorting_and_filters(text_table):
    source = text_table(["v"], [[v] for v in ["b", "É", "e", "A", "a", "", "Straße", "b"]])
    terms = tc.formal_terms(source)
    ascending = tc.sort_summary(terms, "value", keys=["value"], locale_text=True)
    assert [row.value for row in ascending.collect()] == [None, "A", "a", "b", "e", "É", "Straße"]
    descending = tc.sort_summary(terms, "value", True, keys=["value"], locale_text=True)
    assert [row.value for row in descending.collect()] == ["Straße", "e", "É", "b", "A", "a", None]
    found = tc.filter_summary(terms, {"value": {"kind": "contains", "value": "STRASSE"}})
    assert [row.value for row in found.collect()] == ["Straße"]
    assert tc.filter_summary(terms, {"value": {"kind": "missing"}}).count() == 1
    assert tc.filter_summary(terms, {"value": {"kind": "exact", "value": "a"}}).count() == 1


def ids(source):
    return [int(row[0]) for row in tc.in_source_order(source).collect()]


def test_rows_behind_entries(parcels):
    assert ids(tc.rows_with_status(parcels, "weight", "missing")) == [2, 3, 6]
    assert ids(tc.rows_with_status(parcels, "weight", "present")) == [1, 4, 5, 7, 7]
    assert ids(tc.rows_with_pattern(parcels, {"sender": "missing", "weight": "present"})) == [4]
    assert ids(tc.rows_with_term(parcels, "sender", None)) == [2, 4]
    assert ids(tc.rows_with_term(parcels, "weight", "7")) == [4, 5, 7]
    # A marker is never a term of its own.
    assert ids(tc.rows_with_term(parcels, "weight", "unknown")) == []
    assert ids(tc.rows_in_group(parcels, {"sender": None, "weight": "7"})) == [4]
    assert ids(tc.rows_with_format(parcels, "sender", "Oslo")) == []
    assert ids(tc.rows_with_format(parcels, "weight", "<2 digits>")) == [1, 7]


def test_row_filters(parcels):
    def filtered(filters):
        return ids(tc.filter_rows(parcels, filters))

    assert filtered({"sender": {"kind": "contains", "value": "OS"}}) == [1, 5, 7]
    assert filtered({"weight": {"kind": "exact", "value": " UNKNOWN "}}) == [3]
    assert filtered({"weight": {"kind": "missing"}, "note": {"kind": "exact", "value": "fragile"}}) == [2, 6]
    assert filtered({}) == filtered(None) == [1, 2, 3, 4, 5, 6, 7, 7]
    bad = [
        {"x": {"kind": "missing"}}, {"sender": {"kind": "contains", "value": ""}}, {"sender": "x"}, [],
        {"sender": {"kind": "missing", "value": "x"}}, {"sender": {"kind": "exact"}}, {"sender": {"kind": "like", "value": "x"}},
        {1: {"kind": "missing"}}, {"sender": {"kind": "exact", "value": 1}},
        {"sender": {"kind": "exact", "value": "x", "more": 1}},
    ]
    for filters in bad:
        with pytest.raises(RowFilterError):
            filtered(filters)


def test_pages(text_table):
    source = text_table(["id", "v"], [[str(i), "x" if i % 2 else ""] for i in range(107)])
    spread = tc.Table(source.df.repartition(5), source.names, source.markers, source.order)
    pages = [[int(row.id) for row in tc.page(spread, number).collect()] for number in (1, 2, 3, 4)]
    assert pages == [list(range(50)), list(range(50, 100)), list(range(100, 107)), []]
    assert tc.page(spread, 10**30).count() == 0
    half = tc.filter_rows(spread, {"v": {"kind": "missing"}})
    assert tc.row_total(half).head()[0] == 54
    assert [int(row.id) for row in tc.page(half, 2).collect()] == [100, 102, 104, 106]
    numbered = tc.number_rows(half)
    deep = tc.page_of_numbered(half, numbered, 6, page_rows=10)
    assert [int(row.id) for row in deep.collect()] == [100, 102, 104, 106]
    with pytest.raises(ValueError):
        tc.page(spread, 0)


def test_deep_pages_take_the_numbered_way(spark):
    source = tc.table(spark.range(0, 60_000, 1, 7).select((59_999 - F.col("id")).alias("id")), order_by=["id"])
    assert [row.id for row in tc.page(source, 1000).collect()] == list(range(49_950, 50_000))
    assert tc.page(source, 1201).count() == 0


def test_deep_pages_over_ties_are_full_and_disjoint(spark):
    df = spark.range(0, 60_000, 1, 7).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    source = tc.table(df.union(df.where("v < 100")), order_by=["k"])
    numbered = tc.number_rows(source)
    pages = [[(row.k, row.v) for row in tc.page_of_numbered(source, numbered, n).collect()] for n in (401, 402, 403, 404)]
    assert [len(p) for p in pages] == [50] * 4
    assert [k for p in pages for k, _ in p] == sorted(k for p in pages for k, _ in p)
    # Deep and shallow pages number the rows alike.
    assert pages[0] == [(row.k, row.v) for row in tc.page(source, 401).collect()]
    assert pages[2] == [(row.k, row.v) for row in tc.page(source, 403).collect()]
    rows = [row for p in pages for row in p]
    assert len(set(rows)) == 200 - (rows.count((99, 99)) == 2)
    first = [(row.k, row.v) for n in range(1, 6) for row in tc.page(source, n).collect()]
    # k = 0 has 200 rows of its own and row 0 once more: equal rows are shown as often as they occur.
    assert first.count((0, 0)) == 2 and len(set(first)) == 248 + (first.count((1, 1)) < 2)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1290<> digits\\E.-\n", max_size=14), st.text(alphabet="a1<> digits5", max_size=14))
def test_format_regex_describes_exactly_one_format(value, other):
    import re

    def shape(text):
        return re.sub("[0-9]+", lambda run: f"<{len(run.group())} digits>", text) if re.search("[0-9]", text) else None

    # Python spelling of the quoted Java pattern
    def matches(pattern, text):
        java = format_regex(pattern)
        if java is None:
            return False
        java = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m.group(1)), java, flags=re.S)
        return re.fullmatch(java.replace("\\A", "").replace("\\z", "").replace("\\\\E", "\\\\E"), text) is not None

    if shape(value) is not None and "\\E" not in value:
        assert matches(shape(value), value)
        assert matches(shape(value), other) == (shape(other) == shape(value))
    assert format_regex("no digits") is None and format_regex("a1<2 digits>") is None


def test_rows_with_awkward_formats(text_table):
    values = ["a\\E1", "<5 digits>", "x.1", "xy1", "1", "12", "", "a\n1", "12-3"]
    source = text_table(["v"], [[v] for v in values])
    shapes = {
        "a\\E<1 digits>": ["a\\E1"], "<<1 digits> digits>": ["<5 digits>"], "x.<1 digits>": ["x.1"],
        "<2 digits>": ["12"], "a\n<1 digits>": ["a\n1"], "<2 digits>-<1 digits>": ["12-3"],
        "<1 digits><1 digits>": [], "<02 digits>": [], "plain": [],
    }
    for shape, expected in shapes.items():
        assert [row.v for row in tc.rows_with_format(source, "v", shape).to_df().collect()] == expected


CELLS = st.sampled_from(["", " ", "a", "A", "n/a", " N/A", "0", "x1", "x22", "x3", "-"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(CELLS, CELLS), min_size=1, max_size=25))
def test_results_add_up(text_table, rows):
    markers = {"a": ["n/a"]}
    source = text_table(["a", "b"], [list(row) for row in rows], markers)
    folded = {"a": normalize_markers(["n/a"]), "b": frozenset()}
    status = [tuple("missing" if is_missing_text(v or None, folded[n]) else "present" for n, v in zip("ab", r)) for r in rows]
    patterns = tuples(tc.completeness_patterns(source))
    assert {row[:2]: row[2] for row in patterns} == dict(Counter(status))
    assert sum(row[2] for row in patterns) == len(rows)
    for row in tc.column_completeness(source).collect():
        assert row.present_count + row.missing_count == len(rows)
    groups = tuples(tc.group_data(source, ["a", "b"]))
    key = tc.key_uniqueness(source, ["a", "b"]).head()
    assert sum(row[2] for row in groups) == len(rows)
    assert key.singleton_key_count + key.repeated_key_count == key.distinct_key_count == len(groups)
    assert tc.column_profile(source).orderBy("column_index").select("missing_count").collect() == tc.column_completeness(
        source
    ).select("missing_count").collect()


def test_typed_columns_need_no_text(spark):
    df = spark.sql("select id, if(id % 2 = 0, null, cast(id as double)) as d, date'2024-01-01' as day from range(4)")
    source = tc.table(df, {"id": ["3"]})
    assert [row.missing_count for row in tc.column_completeness(source).collect()] == [1, 2, 0]
    plan = tc.column_completeness(tc.table(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_pages_by_index_equal_the_sorted_rows(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice([None, *range(12)]), r.choice([None, "a", "b", "é"]), float(i % 5), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, s string, x double, id int").withColumn("m", F.create_map(F.lit("i"), F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for order in (["k", "s"], ["s"], ["x", "k", "id"]):
            source = tc.table(df.repartition(5), order_by=order)
            index = tc.page_index(source)
            assert index.total == 700
            assert len(index.lows) > 1 or partitions == 1
            pages = [tc.page(source, n, 90, index=index).collect() for n in range(1, 10)]
            assert [len(p) for p in pages] == [90] * 7 + [70, 0]
            found = [row for p in pages for row in p]
            assert sorted(row.id for row in found) == list(range(700))
            key = lambda row: [(row[c] is not None, row[c]) for c in order]
            assert all(key(a) <= key(b) for a, b in zip(found, found[1:], strict=False))
            shallow = [row for n in range(1, 10) for row in tc.page(source, n, 90).collect()]
            assert shallow == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
