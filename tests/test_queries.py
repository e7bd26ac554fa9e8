"""Every registered query against its SQL twin in DuckDB, on whole small tables."""

import decimal
import glob
import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
ORACLES = driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def comparable(rows, columns):
    def plain(value):
        return float(value) if isinstance(value, decimal.Decimal) else value

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_a_twin():
    optional = set(driver.LLM_QUERIES)
    assert set(driver.queries()) - optional == set(ORACLES) - optional


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.LLM_QUERIES)))
def test_query_equals_sql(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    twin = duck.execute(ORACLES[name])
    columns = [column[0] for column in twin.description]
    assert sorted(result.columns) == sorted(columns)
    assert comparable(map(tuple, result.collect()), result.columns) == comparable(twin.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
