"""Queries with a SQL twin against DuckDB, on whole small tables."""

import glob
import math
import os

import duckdb
import pytest


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_mixing", "op6_url_filters", "op9_quality_rules", "op12_personal_data", "op13_hard_negatives"])
def test_query_equals_sql(spark, driver, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    twin = con.execute(driver.oracle_sql()[name])
    columns = sorted(c[0] for c in twin.description)
    order = [[c[0] for c in twin.description].index(c) for c in columns]
    result = driver.queries()[name](spark, sf_dir)
    assert sorted(result.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    want = sorted((tuple(r[i] for i in order) for r in twin.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
