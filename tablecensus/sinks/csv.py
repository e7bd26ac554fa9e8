"""CSV output: every value its own field, formulas made inert, complete and in order.

The files of one export, joined in the order of their names, are one CSV document: the header is
in the first file only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import double_text, whitespace
from ..plans.selection import project_columns
from ..table import Table, by_position

BOM = "\ufeff"
LINE_END = "\r\n"
# A spreadsheet reads text that starts with one of these as a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")


def inert_text(text: Column) -> Column:
    """Prefix an apostrophe when the text, or what follows its leading blanks, starts a formula."""
    visible = F.ltrim(text, F.lit(whitespace()))
    risky = visible.rlike(r"\A[=+\-@]") | text.rlike(r"\A[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def inert_name(name: str) -> str:
    return f"'{name}" if name.startswith(FORMULA_STARTS) or name.lstrip().startswith(FORMULA_STARTS) else name


def _field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text), F.lit(""))


def _record(fields: list[Column]) -> Column:
    if len(fields) == 1:
        # An empty line would not be read back as a record.
        return F.when(fields[0] == "", F.lit('""')).otherwise(fields[0])
    return F.concat_ws(",", *fields)


def _cells(positional: DataFrame, inert: bool) -> list[Column]:
    """The cells as written: inert text unless raw cells are asked for, and doubles at full precision."""
    cells = []
    for field in positional.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            cells.append(inert_text(column) if inert else column)
        elif isinstance(field.dataType, T.DoubleType):
            cells.append(double_text(column))
        else:
            cells.append(column.cast("string"))
    return cells


def csv_lines(df: DataFrame, inert: bool = True) -> DataFrame:
    """One finished CSV ``line`` per row. ``inert=False`` leaves text that starts a formula as it is."""
    positional, _ = by_position(df)
    return positional.select(_record([_field(cell) for cell in _cells(positional, inert)]).alias("line"))


def _header_line(names: Sequence[str], bom: bool, inert: bool) -> str:
    def field(name: str) -> str:
        text = inert_name(name) if inert else name
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text

    fields = [field(name) for name in names]
    line = ",".join(fields) if fields != [""] else '""'
    return (BOM if bom else "") + line


def write_csv(
    df: DataFrame,
    path: str,
    bom: bool = False,
    one_document: bool = True,
    mode: str = "errorifexists",
    inert: bool = True,
) -> None:
    """Write a DataFrame in the order it has. Fails on an existing path unless ``mode`` says else.

    ``inert=False`` writes raw cells, for programs that read the file back; a spreadsheet may execute
    them.

    With ``one_document=False`` every file has its own header and no byte order mark, which suits
    readers that take the files apart.
    """
    if one_document:
        header = F.lit(_header_line(df.columns, bom, inert)).alias("line")
        first = df.sparkSession.range(1).select(header)
        # Union keeps the order of its sides, so the header gets the first file.
        first.unionAll(csv_lines(df, inert)).write.mode(mode).text(path, lineSep=LINE_END)
        return
    # Spark would turn line breaks inside cells into the line end of the file, hence plain "\n".
    empty = "" if len(df.columns) > 1 else '""'
    positional, names = by_position(df)
    named = positional.select(*_cells(positional, inert)).toDF(*(map(inert_name, names) if inert else names))
    named.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        lineSep="\n",
        nullValue=empty,
        emptyValue=empty,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_rows(
    source: Table,
    path: str,
    analysed: Sequence[str] = (),
    column_mode: str = "all",
    one_document: bool = True,
    mode: str = "errorifexists",
    inert: bool = True,
) -> None:
    """Write source rows in source order (or as they come, without one); see ``write_csv`` for ``inert``.

    As one document they start with a byte order mark.
    """
    df = source.df.orderBy(*source.order_columns()) if source.order else source.df
    columns = project_columns(source.names, analysed, column_mode)
    texts = df.select(*[source.text(name) for name in columns]).toDF(*columns)
    write_csv(texts, path, bom=True, one_document=one_document, mode=mode, inert=inert)


def completeness_export(completeness: DataFrame) -> DataFrame:
    """The column completeness table under its export names, in source order of the columns."""
    return completeness.orderBy("column_index").select(
        F.col("column_name").alias("column"),
        "input_rows",
        F.col("present_count").alias("input_rows_with_value"),
        F.col("present_share").alias("share_with_value"),
        F.col("missing_count").alias("input_rows_missing_value"),
        F.col("missing_share").alias("share_missing_value"),
    )


def patterns_export(patterns: DataFrame) -> DataFrame:
    """Every pattern under the export names."""
    statuses = patterns.columns[:-2]
    return patterns.toDF(*statuses, "input_rows", "share_of_input_rows")
