"""Reading and writing CSV files, with Python's csv module as the judge of what was written."""

import csv
import glob
import io
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tablecensus as tc
from tablecensus.functions.text import double_text
from tablecensus.sources.csv import CsvFileError
from tablecensus.table import ROW_ID, NoInputRowsError


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows_of(source):
    return [tuple(row) for row in tc.in_source_order(source).collect()]


FAILURES = (PySparkException, Py4JJavaError, CsvFileError)
READERS = pytest.mark.parametrize("exact", [None, True, False])


@READERS
def test_quotes_bom_and_empty_cells(spark, tmp_path, exact):
    path = write(tmp_path / "a.csv", '﻿"id", name ,id\r\n1,"a ""b"", c",\r\n\r\n2,"", x \r\n')
    source = tc.read_csv(spark, path, exact=exact)
    assert source.names == ("id", "name", "id_1")
    assert rows_of(source) == [("1", 'a "b", c', None), ("2", None, " x ")]


@READERS
def test_line_breaks_inside_quotes(spark, tmp_path, exact):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows_of(tc.read_csv(spark, path, exact=exact)) == [("1", "x\ny"), ("2", "z")]


def test_carriage_returns_inside_quotes_are_kept(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\r\n1,"x\r\ny"\r\n')
    assert rows_of(tc.read_csv(spark, path)) == [("1", "x\r\ny")]


def test_lone_carriage_return_ends_a_row(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\r1,2\r3,4\r")
    assert rows_of(tc.read_csv(spark, path)) == [("1", "2"), ("3", "4")]


@READERS
@pytest.mark.parametrize("content", ["a,b\n1,2\n3\n", "a,b\n1,2,3\n", "a\n1\n1,2\n"])
def test_ragged_rows_fail(spark, tmp_path, exact, content):
    path = write(tmp_path / "a.csv", content)
    with pytest.raises(FAILURES):
        tc.column_completeness(tc.read_csv(spark, path, exact=exact)).collect()
    with pytest.raises(FAILURES):
        tc.row_count(tc.read_csv(spark, path, exact=exact)).collect()


@pytest.mark.parametrize("exact", [None, True])
def test_blank_lines(spark, tmp_path, exact):
    several = write(tmp_path / "a.csv", "name,amount\n\nx,1\n\n,\n")
    assert rows_of(tc.read_csv(spark, several, exact=exact)) == [("x", "1"), (None, None)]
    single = write(tmp_path / "b.csv", 'name\nx\n\n"a,""b"\n" "\n\t\n')
    assert rows_of(tc.read_csv(spark, single, exact=exact)) == [("x",), (None,), ('a,"b',), (" ",), ("\t",)]


def test_whitespace_line_between_several_cells_fails(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n   \n")
    with pytest.raises(CsvFileError):
        tc.read_csv(spark, path)


@pytest.mark.parametrize("content", [b"a,b\n1,\xff\n", b"", b"\n1,2\n", b'"a\n1\n'])
def test_unreadable_files_fail(spark, tmp_path, content):
    with pytest.raises(CsvFileError):
        tc.read_csv(spark, write(tmp_path / "a.csv", content))


def test_text_after_a_closing_quote_fails(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x"y\n')
    with pytest.raises(PySparkException):
        rows_of(tc.read_csv(spark, path))


def test_a_quote_inside_plain_text_is_text(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,x"y\n')
    assert rows_of(tc.read_csv(spark, path)) == [("1", 'x"y')]


def test_header_without_rows(spark, tmp_path):
    source = tc.read_csv(spark, write(tmp_path / "a.csv", "a,b\n"))
    assert rows_of(source) == []
    with pytest.raises(NoInputRowsError):
        tc.require_rows(source)


def test_long_cells_are_read_whole(spark, tmp_path):
    text = "é" * 300_000
    for content in (f"a,b\n1,{text}\n", f'a,b\n"1\n",{text}\n'):
        source = tc.read_csv(spark, write(tmp_path / "a.csv", content))
        assert rows_of(source)[0][1] == text


def test_folder_of_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"part{i}.csv", "h\n" + "".join(f"{i}-{j}\n" for j in range(3)))
    expected = [(f"{i}-{j}",) for i in range(3) for j in range(3)]
    for exact in (None, True):
        assert rows_of(tc.read_csv(spark, str(tmp_path), exact=exact)) == expected
    write(tmp_path / "part9.csv", "other\n1\n")
    for exact in (None, True):
        with pytest.raises(CsvFileError):
            tc.read_csv(spark, str(tmp_path), exact=exact)


def test_source_order_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n" + "".join(f"{i},x{i % 7}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        source = tc.read_csv(spark, path)
        assert source.df.rdd.getNumPartitions() > 3
        assert [row[0] for row in rows_of(source)] == [str(i) for i in range(5000)]
        single = write(tmp_path / "b.csv", "a\n" + "".join(f"{i}\n" for i in range(5000)))
        assert [row[0] for row in rows_of(tc.read_csv(spark, single))] == [str(i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_column_may_be_named_like_the_row_id(spark, tmp_path):
    source = tc.read_csv(spark, write(tmp_path / "a.csv", f"{ROW_ID},`x.y`,X,x\n1,2,3,4\n"))
    assert source.names == (ROW_ID, "`x.y`", "X", "x")
    assert [row.present_count for row in tc.column_completeness(source).collect()] == [1] * 4
    terms = tc.formal_terms(source, ["x", "X"]).select("column_name", "value").collect()
    assert sorted(map(tuple, terms)) == [("X", "3"), ("x", "4")]


HOSTILE = ["=1+1", " =cmd", "@x", "-2", "\tx", 'say "hi", you', "two\nlines", "two\r\nlines", "<b>", "", None, "plain "]


def joined(path):
    return b"".join(open(name, "rb").read() for name in sorted(glob.glob(f"{path}/part-*")))


def test_export_as_one_document(text_table, tmp_path):
    source = text_table(["id", "=sum"], [[str(i), text] for i, text in enumerate(HOSTILE)])
    shuffled = tc.Table(source.df.repartition(5), source.names, source.markers, source.order)
    tc.write_rows(shuffled, str(tmp_path / "out"))
    content = joined(tmp_path / "out")
    assert content.startswith(b"\xef\xbb\xbfid,'=sum\r\n")
    expected = io.StringIO(newline="")
    writer = csv.writer(expected, lineterminator="\r\n")
    writer.writerow(["id", "'=sum"])
    for i, text in enumerate(HOSTILE):
        text = text or ""
        risky = text.startswith(("=", "+", "-", "@", "\t", "\r")) or text.lstrip()[:1] in ("=", "+", "-", "@")
        writer.writerow([str(i), "'" + text if text and risky else text])
    assert content.decode("utf-8-sig") == expected.getvalue()


def test_export_of_chosen_columns_in_source_order(text_table, tmp_path):
    source = text_table(["z", "a", "n"], [["1", "2", "3"]])
    tc.write_rows(source, str(tmp_path / "out"), ["n", "z"], "analysis")
    assert joined(tmp_path / "out").decode("utf-8-sig") == "z,n\r\n1,3\r\n"


def test_single_column_export_keeps_empty_rows(spark, text_table, tmp_path):
    source = text_table(["v"], [["a"], [None], ["b"]])
    tc.write_rows(source, str(tmp_path / "out"))
    assert list(csv.reader(io.StringIO(joined(tmp_path / "out").decode("utf-8-sig")))) == [["v"], ["a"], [""], ["b"]]
    tc.write_rows(source, str(tmp_path / "parts"), one_document=False)
    assert rows_of(tc.read_csv(spark, str(tmp_path / "parts"))) == [("a",), (None,), ("b",)]


def test_parts_can_be_read_back(spark, text_table, tmp_path):
    rows = [[str(i), text or None] for i, text in enumerate(HOSTILE) if not (text or "x")[0] in "=@-\t" and text != " =cmd"]
    source = text_table(["id", "text"], rows)
    tc.write_rows(source, str(tmp_path / "parts"), one_document=False)
    assert sorted(rows_of(tc.read_csv(spark, str(tmp_path / "parts")))) == sorted(map(tuple, rows))


def test_summary_exports(text_table, tmp_path):
    source = text_table(["id", "-x"], [["1", ""], ["2", "a"], ["3", "b"]])
    tc.write_csv(tc.completeness_export(tc.column_completeness(source)), str(tmp_path / "c"))
    assert joined(tmp_path / "c").decode() == (
        "column,input_rows,input_rows_with_value,share_with_value,input_rows_missing_value,share_missing_value\r\n"
        "id,3,3,1.0,0,0.0\r\n"
        f"'-x,3,2,{2 / 3!r},1,{1 / 3!r}\r\n"
    )
    patterns = tc.canonical_order(tc.completeness_patterns(source), ["id", "-x"])
    tc.write_csv(tc.patterns_export(patterns), str(tmp_path / "p"))
    assert joined(tmp_path / "p").decode() == (
        "id,'-x,input_rows,share_of_input_rows\r\n"
        f"present,present,2,{2 / 3!r}\r\npresent,missing,1,{1 / 3!r}\r\n"
    )


def test_share_text_is_the_shortest_exact_form(spark):
    shares = [1 / 3, 1e-5, 0.0002, 1.0, 0.0, 5e-324, 0.1 + 0.2]
    df = spark.createDataFrame([(share,) for share in shares], "s double")
    assert [row[0] for row in df.select(double_text(F.col("s"))).collect()] == [repr(s) for s in shares]


def python_rows(content):
    """What the csv module reads, with empty cells as None and empty lines of wide tables left out."""
    rows = list(csv.reader(io.StringIO(content.removeprefix("\ufeff"), newline=""), strict=True))
    width = len(rows[0])
    return [tuple(cell or None for cell in (row or [""])) for row in rows[1:] if row or width == 1]


@pytest.fixture
def small_splits(spark):
    # Floor of the split size: one open cost.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


PARTS = ["x", "é", ",", '""', "\n", "\r\n", "\r", '"",""', "long cell " * 30, "\n\n\n", "=", '""\n""']


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("seed", range(2))
def test_records_over_many_splits_equal_the_csv_module(spark, tmp_path, small_splits, width, seed):
    r, files = random.Random(seed), []
    for k in range(2):
        lines = [",".join(["\"a\r\nb\"", "plain", "x\"y"][:width])]
        for _ in range(90):
            quoted = ['"' + "".join(r.choice(PARTS) for _ in range(r.randint(0, 6))) + '"' for _ in range(width)]
            cells = [q if r.random() < 0.5 else r.choice(["", "plain", 'mid"quote', "ü" * 20]) for q in quoted]
            lines.append(",".join(cells))
            if r.random() < 0.1:
                lines.append("")
        content = r.choice(["", "\ufeff"]) + r.choice(["\n", "\r\n"]).join(lines)
        files.append(content)
        write(tmp_path / f"f{k}.csv", content)
    source = tc.read_csv(spark, str(tmp_path))
    assert source.df.rdd.getNumPartitions() > 12
    assert source.names[0] == "a\r\nb"
    assert rows_of(source) == python_rows(files[0]) + python_rows(files[1])


def test_a_record_through_several_splits_and_one_that_never_ends(spark, tmp_path, small_splits):
    text = "line\n" * 200
    path = write(tmp_path / "a.csv", f'a,b\n1,"{text}"\n2,"{text}",\n')
    with pytest.raises(FAILURES):
        rows_of(tc.read_csv(spark, path))
    path = write(tmp_path / "b.csv", f'a,b\n1,"{text}"\n2,z\n3,"{text}"')
    assert rows_of(tc.read_csv(spark, path)) == [("1", text), ("2", "z"), ("3", text)]
    path = write(tmp_path / "c.csv", f'a,b\n1,2\n3,"{text}')
    with pytest.raises(FAILURES):
        rows_of(tc.read_csv(spark, path))


def test_raw_cells_are_written_and_read_back(text_table, spark, tmp_path):
    cells = [c for c in HOSTILE if c]
    tc.write_rows(text_table(["=n", "t"], [[str(i), c] for i, c in enumerate(cells)]), str(tmp_path / "raw"), one_document=False, inert=False)
    source = tc.read_csv(spark, str(tmp_path / "raw"))
    assert source.names == ("=n", "t")
    assert sorted(rows_of(source)) == sorted((str(i), c) for i, c in enumerate(cells))
