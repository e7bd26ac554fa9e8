import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tablecensus-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def text_table(spark):
    """Build a text table from a header and rows, in row order."""
    from pyspark.sql import types as T

    from tablecensus.table import ROW_ID, positional_table

    def build(names, rows, missing_markers=None):
        schema = T.StructType(
            [T.StructField(ROW_ID, T.LongType())]
            + [T.StructField(f"f{i}", T.StringType()) for i in range(len(names))]
        )
        data = [(i, *[cell if cell != "" else None for cell in row]) for i, row in enumerate(rows)]
        return positional_table(spark.createDataFrame(data, schema), tuple(names), missing_markers)

    return build
