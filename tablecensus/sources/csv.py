"""CSV files as text tables: comma, header on the first line, UTF-8, strict quoting.

A check over the raw lines decides how the files can be read. When every record sits on one line,
files are split and parsed by Spark. Otherwise (line breaks inside quotes, or quoting that needs
the strict rules) records are regrouped from split files, see ``records.py``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.selection import unique_names
from ..table import ROW_ID, Table, physical, positional_table
from .records import BOM, CsvFileError, first_record, read_records
from .row_ids import file_line_id

QUOTED_FIELD = r'(?:\A\x{FEFF}?|(?<=,))"[^"]*+(?:""[^"]*+)*+"(?=,|\z)'


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    missing_markers: Mapping[str, Sequence[str]] | None = None,
    exact: bool | None = None,
    validate: bool = True,
) -> Table:
    """Read CSV files with one common header. Empty cells are NULL, rows keep a ``_row_id``.

    ``exact=None`` chooses the reader from the check described above. ``exact=True`` always regroups
    records strictly. ``exact=False`` never does: files with line breaks inside quotes are then read
    by Spark's multi-line mode, one task per file, which is lenient about text after a closing
    quote. ``validate=False`` skips the check and needs ``exact`` to be set.
    """
    if not validate and exact is None:
        raise ValueError("Without the check the reader has to be chosen with exact=True or False.")
    files = _list_files(spark, path)
    names = unique_names(first_record(spark, files["first"]))
    facts = _check_lines(spark, path, len(names)) if validate else None
    one_line_records = facts is not None and facts["odd_lines"] == 0
    if files["files"] > 1 and one_line_records:
        _check_headers(spark, path)
    if exact or (exact is None and not one_line_records) or (len(names) == 1 and one_line_records):
        # Spark's reader drops empty lines, which are rows with a missing value in a single column.
        rows = read_records(spark, path, names)
    else:
        rows = _read_with_spark(spark, path, len(names), checked=one_line_records)
    columns = [physical(i) for i in range(len(names))]
    cells = [F.when(F.col(name) != "", F.col(name)).alias(name) for name in columns]
    return positional_table(rows.select(ROW_ID, *cells), names, missing_markers)


def _list_files(spark: SparkSession, path: str | list[str]) -> Row:
    # Without the content column no file is opened.
    listed = spark.read.format("binaryFile").load(path).agg(
        F.min("path").alias("first"),
        F.count(F.lit(1)).alias("files"),
    )
    files = listed.head()
    if not files["files"]:
        raise CsvFileError("There is no file to read.")
    return files


def _check_lines(spark: SparkSession, path: str | list[str], width: int) -> Row:
    """One pass over the raw lines: encoding, quoting, and the number of cells.

    Because every row is checked here, later scans may skip the columns they do not need.
    """
    value = F.col("value")
    rest = F.when(value.contains('"'), F.regexp_replace(value, QUOTED_FIELD, "")).otherwise(value)
    commas = F.octet_length("rest") - F.octet_length(F.replace("rest", F.lit(","), F.lit("")))
    facts = (
        spark.read.text(path)
        .select("value", rest.alias("rest"))
        .agg(
            F.count_if(F.col("rest").contains('"')).alias("odd_lines"),
            F.count_if((value != "") & (commas != width - 1)).alias("ragged_lines"),
            F.count_if(~F.is_valid_utf8(value)).alias("undecodable_lines"),
        )
        .head()
    )
    if facts["undecodable_lines"]:
        raise CsvFileError("The file is not valid UTF-8.")
    if facts["ragged_lines"] and not facts["odd_lines"]:
        raise CsvFileError("The rows of the file do not all have as many cells as the header.")
    return facts


def _check_headers(spark: SparkSession, path: str | list[str]) -> None:
    """The first line of every file, found in one scan that keeps one line per file and task."""
    lines = spark.read.text(path).select(file_line_id().alias(ROW_ID), "value").where(f"{ROW_ID}.block = 0")
    first = lines.groupBy(f"{ROW_ID}.file").agg(F.min_by("value", F.col(f"{ROW_ID}.line")).alias("header"))
    if first.select(F.ltrim("header", F.lit(BOM))).distinct().limit(2).count() > 1:
        raise CsvFileError("The files do not share one header.")


def _read_with_spark(
    spark: SparkSession, path: str | list[str], width: int, checked: bool
) -> DataFrame:
    schema = ", ".join(f"{physical(i)} string" for i in range(width))
    # Spark only counts the cells of a row when it parses all of them.
    return spark.read.option("columnPruning", checked).csv(
        path,
        schema=schema,
        header=True,
        enforceSchema=True,
        escape='"',
        multiLine=not checked,
        mode="FAILFAST",
        maxColumns=max(20_480, width + 1),
    ).select(file_line_id().alias(ROW_ID), "*")
