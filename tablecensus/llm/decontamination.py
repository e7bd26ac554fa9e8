"""Benchmark decontamination: q-gram lemma filter in overlapping diagonal bands, then banded alignment.

An occurrence of an item of m bytes with at most k edits shares at least m + 1 - q - k q of its
q-grams with the document, all within k + 1 neighbouring diagonals. Bands of twice that width, one
starting at every (k + 1)-th diagonal, hold every such occurrence whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
#: Bytes of text scanned at once; pieces of a longer text overlap by more than an item.
PIECE = 1 << 20
#: Characters of items in one index; further items form further indexes.
MAX_INDEX_CHARS = 4_000_000


def plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case (A-Z) with runs of white space as one space; and which bytes stay."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    stay = ~blank
    stay[1:] |= ~blank[:-1]
    c = np.where((data >= 65) & (data <= 90), data | 32, data)
    c[blank] = 32
    return c[stay], stay


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row boundaries of a string column; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of ``q`` characters, from windows of half the length."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    h, size = c.astype(np.uint64) + np.uint64(1), 1
    parts, rest = [], q
    while True:
        if rest & 1:
            parts.append((h, size))
        rest >>= 1
        if not rest:
            break
        h = h[:-size] * MIX + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    n = len(c) - q + 1
    out, at = np.zeros(n, np.uint64), 0
    for h, size in parts:
        out = out * MIX + h[at : at + n] if at else h[:n].copy()
        at += size
    out *= MIX
    out ^= out >> np.uint64(32)
    out *= MIX
    return out


def aligned_edits(item: np.ndarray, region: np.ndarray, width: int, budget: int) -> int:
    """Fewest edits of ``item`` against any part of ``region`` that starts on its first diagonals.

    Gives up with more than ``budget`` as soon as no cell of the band is within it.
    """
    padded = np.full(len(item) + width, 0, np.uint8)
    padded[: min(len(region), len(padded))] = region[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    offsets = np.arange(width, dtype=np.int32)
    row = np.zeros(width, np.int32)
    for at in range(0, len(item), 8):
        for differs in windows[at : at + min(8, len(item) - at)] != item[at : at + 8, None]:
            fresh = row + differs
            np.minimum(fresh[:-1], row[1:] + 1, out=fresh[:-1])
            fresh -= offsets
            np.minimum.accumulate(fresh, out=fresh)
            fresh += offsets
            row = fresh
        if row.min() > budget:
            return budget + 1
    return int(row.min())


class PassageIndex:
    """q-grams of a block of items, with the number each item needs in one band."""

    def __init__(self, items: list[tuple[int, str]], q: int, max_error: float, min_chars: int):
        kept = [(i, c) for i, t in items if len(c := plain(np.frombuffer(t.encode(), np.uint8))[0]) >= min_chars]
        self.q, self.ids, self.items = q, [i for i, _ in kept], [c for _, c in kept]
        size = np.array([len(c) for c in self.items], np.int64)
        # As many edits as asked for, but so few that at least one shared q-gram is certain.
        self.edits = np.minimum(np.floor(size * max_error).astype(np.int64), np.maximum(0, (size - q) // q))
        self.need = size + 1 - q - self.edits * q
        self.size, self.longest = size, int(size.max(initial=0))
        hashes = [gram_hashes(c, q) for c in self.items]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.start = np.unique(flat[order], return_index=True)
        self.stop = np.r_[self.start[1:], len(flat)].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def found(self, column: pa.Array) -> list[dict[int, float]]:
        """For each row, the items that occur within the edit budget, and their best similarity."""
        out: list[dict[int, float]] = [{} for _ in range(len(column))]
        if not self.items or not len(column):
            return out
        data, bounds = text_bytes(column)
        c, stay = plain(data)
        bounds = np.r_[0, np.cumsum(stay)][bounds]
        pieces: list[tuple[int, int, int]] = []
        size = 0
        for row in range(len(column)):
            for at in range(int(bounds[row]), int(bounds[row + 1]), PIECE):
                pieces.append((row, at, min(int(bounds[row + 1]), at + PIECE + 2 * self.longest)))
                size += pieces[-1][2] - at
                if size >= PIECE:
                    self.scan(c, pieces, out)
                    pieces, size = [], 0
        if pieces:
            self.scan(c, pieces, out)
        return out

    def scan(self, c: np.ndarray, pieces: list[tuple[int, int, int]], out: list[dict[int, float]]) -> None:
        size = np.array([b - a for _, a, b in pieces], np.int64)
        begin = np.r_[0, np.cumsum(size)]
        part = np.concatenate([c[a:b] for _, a, b in pieces])
        h = gram_hashes(part, self.q)
        seen = self.filter[(h >> np.uint64(64 - FILTER_BITS)).view(np.int64)]
        for at in begin[1:-1]:  # no q-gram crosses from one piece into the next
            seen[max(0, at - self.q + 1) : at] = False
        maybe = np.flatnonzero(seen)
        rank = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        sure = self.grams[rank] == h[maybe]
        maybe, rank = maybe[sure], rank[sure]
        if not len(maybe):
            return
        count = self.stop[rank] - self.start[rank]
        hit = np.repeat(self.start[rank] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        item, place = self.owner[hit], self.place[hit]
        at = np.repeat(maybe, count)
        piece = np.searchsorted(begin, at, side="right") - 1
        band = (at - begin[piece] - place) // (self.edits[item] + 1) + self.longest + 1
        span = np.int64(int(size.max()) + self.longest + 3)
        key = (piece * len(self.items) + item) * span + band
        key = np.concatenate([key, key - 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tail = np.r_[head[1:], len(key)]
        full = tail - head >= self.need[key[head] // span % len(self.items)]
        for s, e in zip(head[full], tail[full], strict=True):
            i, p = int(key[s] // span % len(self.items)), int(key[s] // span // len(self.items))
            shared = np.unique(place[order[s:e] % len(place)])
            row, lo_piece, hi_piece = pieces[p]
            if len(shared) < self.need[i] or out[row].get(self.ids[i]) == 1.0:
                continue
            w = int(self.edits[i]) + 1
            lo = (int(key[s] % span) - self.longest - 1) * w
            region = c[lo_piece + max(0, lo) : max(lo_piece, min(hi_piece, lo_piece + lo + 2 * w + int(self.size[i])))]
            if lo < 0:
                region = np.r_[np.zeros(-lo, np.uint8), region]
            edits = aligned_edits(self.items[i], region, 2 * w, int(self.edits[i]))
            if edits <= self.edits[i]:
                out[row][self.ids[i]] = max(out[row].get(self.ids[i], 0.0), 1 - edits / int(self.size[i]))


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the benchmark is the query set, documents are the data."""
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if size + len(row["text"]) > MAX_INDEX_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], row["text"]))
        size += len(row["text"])
    return blocks


def _with_items(docs: DataFrame, benchmark: DataFrame, q: int, max_error: float, min_chars: int) -> DataFrame:
    """``docs`` (``_row``, ``text``) with ``_found``, the items found as structs of id and similarity."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_found", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())])))])
    out = docs.withColumn("_found", F.array().cast(schema["_found"].dataType))
    for block in item_blocks(benchmark):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(block, q, max_error, min_chars)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    names = part.schema.names
                    before = part.column(names.index("_found")).to_pylist()
                    hits = index.found(part.column(names.index("text")))
                    found = [f + [{"item_id": i, "similarity": s} for i, s in sorted(h.items())] for f, h in zip(before, hits, strict=True)]
                    kind = part.schema.field("_found").type
                    columns = [pa.array(found, kind) if n == "_found" else part.column(n) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, names)

        out = out.mapInArrow(search, schema)
    return out


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, q: int = 8, max_error: float = 0.1, min_chars: int = 30) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids, similarity (of the best item).

    Upper case A-Z and runs of white space do not count; lengths and edits are in UTF-8 bytes. An item occurs when a part of the document is within
    ``max_error`` edits per byte of it. Items under ``min_chars`` bytes, null items and null
    item ids are never found; null and empty texts hold none. Repeated rows are judged each for
    itself, equal item ids are reported once, other columns are ignored, empty tables give empty
    results or no findings.
    """
    out = _with_items(docs.select("doc_id", "text"), benchmark, q, max_error, min_chars)
    ids = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["item_id"])))
    out = out.select("doc_id", ids.alias("item_ids"), F.array_max(F.transform("_found", lambda x: x["similarity"])).alias("similarity"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = 8, max_error: float = 0.1, min_chars: int = 30) -> DataFrame:
    """``docs`` without the documents that hold an item, all columns kept."""
    packed = docs.select(F.struct("*").alias("_row"))
    packed = packed.select("_row", F.col("_row.text").alias("text"))
    return _with_items(packed, benchmark, q, max_error, min_chars).where(F.size("_found") == 0).select("_row.*")
