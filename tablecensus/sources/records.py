"""Records over several lines, from files that are read in splits.

Whether a line begins inside quotes depends on all lines before it, and a split does not see those
of other splits. So a first scan finds, for every split, in which state it would end from either
state; chaining these (one small row per split) gives each split's true state, and the split where
the record began that runs into it. The second scan parses the records that lie in one split. The
pieces of the others, at most two per split, meet by the split where the record began.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.selection import unique_names
from ..table import ROW_ID, physical

BOM = "\ufeff"
LINE_ID_TYPE = "struct<file: string, block: bigint, line: bigint>"
#: Rows and characters of cells in one batch of results.
BATCH_ROWS, BATCH_CHARACTERS = 10_000, 1 << 23
#: A line, begun outside quotes, that ends inside: whole fields with their commas, then an open one.
OPENS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+),)*+"[^"]*+(?:""[^"]*+)*+\Z')
PIECE = "file string, opener bigint, block bigint, line bigint, piece string"

Split = tuple[str, int]


class CsvFileError(ValueError):
    """The file is not a rectangular CSV table."""


def inside_after(line: str, inside: bool) -> bool:
    """Whether the next line begins inside quotes. A line inside quotes reads like one after an opening quote."""
    if '"' not in line:
        return inside
    return OPENS.match('"' + line if inside else line) is not None


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split. Only LF separates them here, so that carriage returns stay in place."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", "value")


def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, Iterator[str]]]:
    """The lines of one split after the other, with their line ends; a lone carriage return ends a line too."""

    def lines() -> Iterator[tuple[Split, str]]:
        for batch in batches:
            for file, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if "\r" in value:
                    yield from (((file, block), part) for part in io.StringIO(value + "\n", newline=""))
                else:
                    yield (file, block), value + "\n"

    def bare(split: Split, members: Iterator[tuple[Split, str]]) -> Iterator[str]:
        for k, (_, line) in enumerate(members):
            yield line.removeprefix(BOM) if k == 0 and split[1] == 0 else line

    try:
        for split, members in groupby(lines(), key=lambda pair: pair[0]):
            yield split, bare(split, members)
    except UnicodeDecodeError as error:
        raise CsvFileError("The file is not valid UTF-8.") from error


class Feed:
    """Lines for the csv module, remembering those of the record that is being read."""

    def __init__(self, lines: Iterator[str]):
        self.lines, self.number, self.held, self.over = lines, 0, [], False

    def __iter__(self) -> Feed:
        return self

    def __next__(self) -> str:
        for line in self.lines:
            self.number += 1
            self.held.append(line)
            return line
        self.over = True
        raise StopIteration

    def open_at_end(self) -> bool:
        inside = False
        for line in self.held:
            inside = inside_after(line.rstrip("\r\n"), inside)
        return self.over and inside


def first_record(spark: SparkSession, file: str) -> list[str]:
    """The header, parsed where the file is read; one row reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        header, error = [], None
        try:
            split = next(splits(batches), None)
            if split and split[0][1] == 0:
                header = next(csv.reader(split[1], strict=True), [])
        except (csv.Error, CsvFileError) as found:
            error = str(found)
        if header or error:
            yield pa.RecordBatch.from_arrays([pa.array([header], pa.list_(pa.string())), pa.array([error], pa.string())], ["header", "error"])

    found = raw_lines(spark, file).mapInArrow(work, "header array<string>, error string").limit(1).collect()
    if found and found[0]["error"]:
        raise CsvFileError(f"The header cannot be read: {found[0]['error']}")
    if not found or not found[0]["header"]:
        raise CsvFileError("The file has no header.")
    return found[0]["header"]


def openers(spark: SparkSession, path: str | list[str]) -> tuple[dict[Split, int | None], bool]:
    """For each split the start of the split in which the record began that runs into it, if one does.

    Also whether any split ends inside a record. One entry per split.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines in splits(batches):
            ends, begins = [False, True], [False, False]
            for line in lines:
                begins = [b or not inside for b, inside in zip(begins, ends, strict=True)]
                if '"' in line:
                    text = line.rstrip("\r\n")
                    ends = [inside_after(text, inside) for inside in ends] if ends[0] != ends[1] else [inside_after(text, ends[0])] * 2
            columns = [[file], [block], [ends[0]], [ends[1]], [begins[0]], [begins[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "block", "end0", "end1", "begin0", "begin1"])

    schema = "file string, block bigint, end0 boolean, end1 boolean, begin0 boolean, begin1 boolean"
    found: dict[Split, int | None] = {}
    any_open, file_before, inside, opener = False, None, False, None
    for row in sorted(raw_lines(spark, path).mapInArrow(work, schema).collect()):
        if row["file"] != file_before:
            file_before, inside, opener = row["file"], False, None
        found[row["file"], row["block"]] = opener if inside else None
        if row["begin1"] if inside else row["begin0"]:
            opener = row["block"]
        inside = row["end1"] if inside else row["end0"]
        any_open |= inside
    return found, any_open


def read_records(spark: SparkSession, path: str | list[str], names: tuple[str, ...]) -> DataFrame:
    """Row id and cells of all records; every file has to begin with the header ``names``."""
    known, any_open = openers(spark, path)
    width = len(names)
    columns = [physical(i) for i in range(width)]
    schema = f"file string, block bigint, line bigint, {', '.join(f'{name} string' for name in columns)}"

    def opener_of(split: Split) -> int | None:
        if split not in known:
            raise CsvFileError("The files, or how they are split, have changed since they were looked at: read them again.")
        return known[split]

    def checked(record: list[str], file: str) -> list[str]:
        # An empty line is a row only where there is one column.
        record = record or [""]
        if len(record) != width:
            raise CsvFileError(f"{file}: a row does not have {width} cells.")
        return record

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        data = [pa.array(c, pa.string() if k not in (1, 2) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays(data, ["file", "block", "line", *columns])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for (file, block), lines in splits(batches):
            feed, inside = Feed(lines), opener_of((file, block)) is not None
            while inside and (line := next(feed, None)) is not None:
                inside = inside_after(line.rstrip("\r\n"), True)
            reader, rows, size = csv.reader(feed, strict=True), [], 0
            is_header = block == 0
            while True:
                feed.held.clear()
                at = feed.number
                try:
                    record = next(reader, None)
                except csv.Error as error:
                    if feed.open_at_end() and not is_header:
                        break
                    raise CsvFileError(f"{file}: {error}") from error
                if record is None:
                    break
                if is_header:
                    if unique_names(record) != names:
                        raise CsvFileError(f"{file}: the header differs from the first file.")
                    is_header = False
                elif record or width == 1:
                    rows.append((file, block, at, *checked(record, file)))
                    size += sum(map(len, record))
                    if len(rows) == BATCH_ROWS or size > BATCH_CHARACTERS:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines in splits(batches):
            opener, rows = opener_of((file, block)), []
            inside, begun, at, held = opener is not None, False, 0, []
            for number, line in enumerate(lines):
                if not inside:
                    begun, at, held = True, number, []
                held.append(line)
                inside = inside_after(line.rstrip("\r\n"), inside)
                if not inside and not begun:
                    rows.append((file, opener, block, 0, "".join(held)))
            if inside:
                rows.append((file, block if begun else opener, block, at, "".join(held)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                data = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(data, ["file", "opener", "block", "line", "piece"])

    def joined(parts: pa.Table) -> pa.Table:
        """The one record whose pieces these are."""
        csv.field_size_limit(2**31 - 1)
        ordered = sorted(parts.to_pylist(), key=lambda p: p["block"])
        first = ordered[0]
        text = io.StringIO("".join(p["piece"] for p in ordered), newline="")
        try:
            (record,) = csv.reader(text, strict=True)
        except csv.Error as error:
            raise CsvFileError(f"{first['file']}: {error}") from error
        return pa.Table.from_batches([batch_of([(first["file"], first["opener"], first["line"], *checked(record, first["file"]))])])

    rows = raw_lines(spark, path).mapInArrow(parse, schema)
    if any_open:
        apart = raw_lines(spark, path).mapInArrow(pieces, PIECE)
        rows = rows.union(apart.groupBy("file", "opener").applyInArrow(joined, schema))
    row_id = F.struct("file", "block", "line").cast(LINE_ID_TYPE)
    return rows.select(row_id.alias(ROW_ID), *columns)
