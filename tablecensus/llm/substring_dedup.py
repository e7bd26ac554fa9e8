"""Exact removal of repeated byte strings by a sampled suffix sort with a content-chosen difference cover.

* Sample: positions whose 16-byte block has the least hash among some 35 neighbouring blocks. Every
  50-byte string holds such a position, at the same place in all of its copies: the sample is a cover
  for any two equal strings, as a difference cover modulo a period is, with a fifth of its positions.
* Names: sampled suffixes are sorted by the name of their block, then by the name of the triple of
  blocks around it (34 bytes, block, 34 bytes). A block without a second document ends there. Within
  equal triples all strings through the block are equal: all members but the first document's are
  covered. Names are 64-bit and 48-bit hashes; only equality matters, so no ranks are needed.
* Merge: the remaining suffixes are the 50-byte strings through blocks that continue differently.
  They are named by 96 bits, sorted, and equal neighbours are compared by document.
* Memory: equal names are compared where they arise, so that a name that most documents hold is sent
  once for some thousand documents. A bucket of names that still is too large goes through files.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 16
#: Hash buckets of the exchange, at least; a task works off one bucket after the other.
BUCKETS = 512
#: Bytes of text in numpy arrays at once, and sampled positions held before they are sent.
CHUNK, HELD = 1 << 20, 1 << 19
#: Rows of a bucket in memory, and the files that a larger one is dealt over.
MOST, PARTS = 1 << 19, 64
#: Places that are settled before the exchange, in one blob, and rows in one batch of blobs.
SETTLED, BATCH = 1 << 13, 1 << 16
#: Place of rows without a doc_id: after all others.
NO_ID = np.iinfo(np.int64).max


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


class Powers:
    """Hashes of all windows of several sizes from hashes of windows of 1, 2, 4, ... bytes."""

    def __init__(self, data: np.ndarray, most: int):
        self.levels = [data.astype(np.uint64) * MIX2 + MIX]
        size = 1
        while size * 2 <= most and len(self.levels[-1]) > size:
            h = self.levels[-1]
            h = h[:-size] * MIX + h[size:]
            self.levels.append(h ^ (h >> np.uint64(31)))
            size *= 2

    def at(self, start: np.ndarray, size: np.ndarray | int, seed: int = 0) -> np.ndarray:
        """Hashes of the windows ``[start, start + size)``."""
        rest = np.full(start.shape, size, np.int64)
        out = np.full(start.shape, seed, np.uint64) + rest.astype(np.uint64)
        place = start.astype(np.int64)
        for bit, h in reversed(list(enumerate(self.levels))):
            for _ in range(2 if bit == len(self.levels) - 1 else 1):
                use = rest >= (1 << bit)
                if use.all():
                    out = out * MIX2 + finish(h[place])
                    place += 1 << bit
                    rest -= 1 << bit
                elif use.any():
                    out[use] = out[use] * MIX2 + finish(h[place[use]])
                    place[use] += 1 << bit
                    rest[use] -= 1 << bit
        return finish(out)


def spread(h: np.ndarray, width: int, pick) -> np.ndarray:
    """Running minimum or maximum over ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def sample(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, Powers]:
    """Sampled positions and their block hashes."""
    powers = Powers(data, BLOCK * 2)
    width = length - BLOCK + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), powers
    h = finish(powers.levels[4][: len(data) - BLOCK + 1])
    least = spread(h, width, np.minimum)
    # A block is sampled if it is the least of some window that holds it.
    padded = np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]
    at = np.flatnonzero(spread(padded, width, np.maximum) == h)
    return at, h[at], powers


#: A name (a block and its context, or a string) and its place: hashes, doc_id and text hashes, position.
PLACE = np.dtype([("id", "i8"), ("v", "i8"), ("w", "i8"), ("pos", "u4")])
ANCHOR = np.dtype([("a", "u8"), ("b", "u4"), ("e", "u2"), ("lh", "u1"), ("rh", "u1"), *PLACE.descr])
STRING = np.dtype([("a", "u8"), ("b", "u4"), *PLACE.descr])


def gathered(held: list[tuple[tuple[int, int, int], list[np.ndarray]]], kind: np.dtype, names: list[str]) -> np.ndarray:
    """One table of the columns of several texts, which are let go."""
    n = [len(columns[0]) for _, columns in held]
    out = np.empty(sum(n), kind)
    for k, name in enumerate(names):
        out[name] = np.concatenate([columns[k] for _, columns in held])
    for k, name in enumerate(("id", "v", "w")):
        out[name] = np.repeat(np.array([text[k] for text, _ in held], np.int64), n)
    held.clear()
    return out


def pack(rows: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Pieces of the rows, all first bytes before all second ones: high zero bytes compress away."""
    flat = rows.view(np.uint8).reshape(len(rows), rows.itemsize)
    return [flat[lo:hi].T.tobytes() for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """Rows of all blobs."""
    ends = np.cumsum([0, *(len(x) // kind.itemsize for x in blobs)]).tolist()
    out = np.empty(ends[-1], kind)
    flat = out.view(np.uint8).reshape(len(out), kind.itemsize)
    for blob, lo, hi in zip(blobs, ends[:-1], ends[1:], strict=True):
        flat[lo:hi] = np.frombuffer(blob, np.uint8).reshape(kind.itemsize, hi - lo).T
    return out


def second(rows: np.ndarray) -> np.ndarray:
    """The other part of a name."""
    b = rows["b"].astype(np.uint64)
    return (b << np.uint64(16)) | rows["e"] if "e" in rows.dtype.names else b


def heads(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def repeated(sorted_: np.ndarray) -> np.ndarray:
    """Whether a neighbour is equal."""
    same = sorted_[1:] == sorted_[:-1]
    return np.r_[same, np.zeros(1, bool)] | np.r_[np.zeros(1, bool), same] if len(sorted_) else np.zeros(0, bool)


def later(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the same name has a smaller id too."""
    order = np.lexsort((ids, b, a))
    start, i = heads(a[order], b[order]), ids[order]
    out = np.empty(len(a), bool)
    out[order] = i != np.repeat(i[start], np.diff(np.r_[start, len(a)]))
    return out


def by_bucket(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Names in blobs by bucket. Of an equal name only the least id has to be compared elsewhere: the
    places of the others are settled, and spread over the buckets by themselves."""
    # Blocks are least hashes, which are small ones, so their own bits would fill a few buckets only.
    rows["a"] = h = finish(rows["a"])
    order = np.argsort(h)
    twin = order[repeated(h[order])]
    some, gone = rows.take(twin), np.zeros(len(rows), bool)
    gone[twin] = later(h[twin], second(some), some["id"])
    settled, stay = rows.take(np.flatnonzero(gone)), np.flatnonzero(~gone)
    # In the order of the documents, so that their ids compress away.
    bucket = (((h[stay] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows.take(stay[order])
    start = heads(bucket)
    yield from blobs(bucket[start], False, rows, np.r_[start, len(rows)])
    if len(settled):
        ends = np.r_[0 : len(settled) : SETTLED, len(settled)]
        first = settled.take(ends[:-1])
        mix = finish(finish(first["id"].astype(np.uint64) ^ first["v"].astype(np.uint64)) + first["pos"].astype(np.uint64))
        places_ = np.empty(len(settled), PLACE)
        for name in PLACE.names:
            places_[name] = settled[name]
        yield from blobs(mix % np.uint64(buckets), True, places_, ends)


def blobs(bucket: np.ndarray, settled: bool, rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Small batches: the JVM and the worker hold copies of each."""
    step = max(1, len(bucket) * BATCH // len(rows))
    for lo in range(0, len(bucket), step):
        data = pack(rows, ends[lo : lo + step + 1])
        columns = [pa.array(bucket[lo : lo + step].astype(np.int32)), pa.array([settled] * len(data), pa.bool_()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "settled", "data"])


def buckets_of(df: DataFrame) -> int:
    """More buckets than partitions, so that a bucket shrinks where the partitions of a larger job do."""
    return max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A text: its doc_id, and two hashes of it where rows share a doc_id or have none.
TEXT = ["_id", "_v", "_w"]
PLACES = "_id long, _v long, _w long, pos int, kind int"
BLOBS = "bucket int, settled boolean, data binary"
COVERED, OPEN, WINDOW = 0, 1, 2


def places(rows: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(rows[k])) for k in ("id", "v", "w")]
    columns += [pa.array(rows["pos"].astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32))]
    return pa.RecordBatch.from_arrays(columns, [*TEXT, "pos", "kind"])


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Sampled positions with the hashes of their block, context and both sides, in blobs by bucket."""
    side = (length - BLOCK + 1) // 2
    reach = length - BLOCK
    buckets = buckets_of(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int, int], list[np.ndarray]]] = []
        n = 0

        with np.errstate(over="ignore"):
            for batch in batches:
                keys = [batch.column(k).to_pylist() for k in range(3)]
                for i, v, w, t in zip(*keys, batch.column(3), strict=True):
                    data = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                    for start in range(0, max(1, len(data) - length + 1), CHUNK):
                        # Pieces overlap by a whole context on both sides of what they report.
                        lo = max(0, start - 2 * length)
                        part = data[lo : start + CHUNK + 3 * length]
                        at, g, powers = sample(part, length)
                        own = (at >= start - lo) & (at < start - lo + CHUNK)
                        at, g = at[own], g[own]
                        if not len(at):
                            continue
                        left, right = np.maximum(0, at - reach), np.minimum(len(part), at + length)
                        c = powers.at(left, right - left, 1)
                        near_l, near_r = np.maximum(0, at - side), np.minimum(len(part), at + BLOCK + side)
                        lh = powers.at(near_l, at - near_l, 2)
                        rh = powers.at(at, near_r - at, 3)
                        held.append(((i, v, w), [g, c >> np.uint64(32), c, lh, rh, at + lo]))
                        n += len(at)
                        if n >= HELD:
                            yield from by_bucket(gathered(held, ANCHOR, ["a", "b", "e", "lh", "rh", "pos"]), buckets)
                            n = 0
            if held:
                yield from by_bucket(gathered(held, ANCHOR, ["a", "b", "e", "lh", "rh", "pos"]), buckets)

    return docs.mapInArrow(work, BLOBS)


def dealt(pieces: Iterable[np.ndarray], pick: Callable[[np.ndarray], np.ndarray]) -> list[BinaryIO]:
    """Rows in temporary files, by the low bits of a hash."""
    files = [tempfile.TemporaryFile() for _ in range(PARTS)]
    for rows in pieces:
        part = (pick(rows) % np.uint64(PARTS)).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(PARTS + 1))
        for file, lo, hi in zip(files, ends[:-1], ends[1:], strict=True):
            file.write(rows[order[lo:hi]].tobytes())
    return files


def read(file: BinaryIO, kind: np.dtype, most: int) -> Iterator[np.ndarray]:
    file.seek(0)
    while raw := file.read(most * kind.itemsize):
        yield np.frombuffer(raw, kind)


def met(names: DataFrame, kind: np.dtype, late: int, decide: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rest: bool) -> DataFrame:
    """Places of names that a smaller id has too, as ``late``, and the places that ``decide`` leaves open.

    ``decide`` gets all names of a bucket and gives (late, open) rows. A bucket of more than ``MOST`` rows
    is dealt over files by the first part of its names; where that does not make it smaller, because
    most rows share it, by the second part, and then all places that are not late are open with ``rest``.
    """
    most = MOST

    def large(files: list[BinaryIO]) -> Iterator[pa.RecordBatch]:
        for file in files:
            if file.tell() <= most * kind.itemsize:
                for rows in read(file, kind, most):
                    yield from decided(rows)
            else:
                for part in dealt(read(file, kind, most // 4), lambda rows: finish(second(rows) + MIX)):
                    yield from streamed(part)
            file.close()

    def streamed(file: BinaryIO) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, kind)  # the least id of each name
        for rows in read(file, kind, most // 4):
            known = np.r_[known, rows]
            a, b = known["a"], second(known)
            order = np.lexsort((known["id"], b, a))
            known = known[order[heads(a[order], b[order])]]
        for rows in read(file, kind, most // 4):
            both = np.r_[known, rows]
            gone = later(both["a"], second(both), both["id"])[len(known) :]
            yield places(rows[gone], late)
            if rest:
                yield places(rows[~gone], OPEN)
        file.close()

    def decided(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        # A name whose first part is alone meets nothing.
        order = np.argsort(rows["a"])
        for found, as_ in zip(decide(rows.take(order[repeated(rows["a"][order])])), (late, OPEN), strict=True):
            if len(found):
                yield places(found, as_)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[bytes] = []

        def pieces() -> Iterator[np.ndarray]:
            held: list[bytes] = []
            n = 0
            for batch in batches:
                for settled, data in zip(batch.column("settled").to_pylist(), batch.column("data"), strict=True):
                    (done if settled else held).append(data.as_py())
                    n += 0 if settled else len(held[-1]) // kind.itemsize
                    if n > most:
                        yield unpack(held, kind)
                        held.clear()
                        n = 0
            yield unpack(held, kind)

        with np.errstate(over="ignore"):
            all_ = pieces()
            first = next(all_)
            if len(first) <= most:
                yield from decided(first)
            else:
                yield from large(dealt(itertools.chain([first], all_), lambda rows: finish(rows["a"])))
        if done:
            yield places(unpack(done, PLACE), late)

    return names.groupBy("bucket").applyInArrow(work, PLACES)


def settle(names: DataFrame) -> DataFrame:
    """Places covered by equal contexts, and places whose block continues differently elsewhere."""

    def decide(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = second(rows)
        order = np.lexsort((rows["id"], c, rows["a"]))
        rows, c = rows.take(order), c[order]
        g, ids = np.ascontiguousarray(rows["a"]), np.ascontiguousarray(rows["id"])
        start = heads(g, c)
        size = np.diff(np.r_[start, len(g)])
        gone = ids != np.repeat(ids[start], size)
        # Contexts of one block that agree on the block and one side may share a string.
        block = np.cumsum(np.r_[True, g[start][1:] != g[start][:-1]]) if len(g) else np.empty(0, np.int64)

        def shared(side: np.ndarray) -> np.ndarray:
            key = block.astype(np.int64) * 256 + side[start]
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            return n[inverse] > 1

        open_ = np.repeat(shared(rows["lh"]) | shared(rows["rh"]), size) & ~gone
        return rows[gone], rows[open_]

    return met(names, ANCHOR, COVERED, decide, True)


def strings(docs: DataFrame, length: int) -> DataFrame:
    """The strings through open places (``_id, _v, _w, z, places``), in blobs by bucket."""
    buckets = buckets_of(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        held: list[tuple[tuple[int, int, int], list[np.ndarray]]] = []
        n = 0

        with np.errstate(over="ignore"):
            for batch in batches:
                keys = [batch.column(k).to_pylist() for k in range(3)]
                for i, v, w, z, at in zip(*keys, batch.column(3), lists(batch.column(4)), strict=True):
                    data = np.frombuffer(unzip(z.as_py()), np.uint8)
                    a = np.unique(at)
                    for lo in range(0, len(data), CHUNK):
                        near = a[np.searchsorted(a, lo) : np.searchsorted(a, lo + CHUNK + length)]
                        # Starts of the strings through these places, in this piece and inside the text.
                        mark = np.zeros(min(CHUNK, len(data) - lo) + 1, np.int32)
                        np.add.at(mark, np.clip(near - (length - BLOCK) - lo, 0, len(mark) - 1), 1)
                        np.add.at(mark, np.clip(near + 1 - lo, 0, len(mark) - 1), -1)
                        p = np.flatnonzero(np.cumsum(mark[:-1]) > 0) + lo
                        p = p[p + length <= len(data)]
                        if not len(p):
                            continue
                        powers = Powers(data[lo : lo + CHUNK + length], BLOCK * 2)
                        w1, w2 = powers.at(p - lo, length, 5), powers.at(p - lo, length, 6)
                        held.append(((i, v, w), [w1, w2, p]))
                        n += len(p)
                        if n >= HELD:
                            yield from by_bucket(gathered(held, STRING, ["a", "b", "pos"]), buckets)
                            n = 0
            if held:
                yield from by_bucket(gathered(held, STRING, ["a", "b", "pos"]), buckets)

    return docs.mapInArrow(work, BLOBS)


def compared(names: DataFrame) -> DataFrame:
    """Starts of strings that also start in a document with a smaller id."""

    def decide(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[later(rows["a"], second(rows), rows["id"])], rows[:0]

    return met(names, STRING, WINDOW, decide, False)


def zipped(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for the joins by document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [squeeze(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(z, pa.binary())], [*TEXT, "z"])

    return docs.mapInArrow(work, "_id long, _v long, _w long, z binary")


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column of numbers without Python objects; null is an empty list."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return iter(np.split(values, ends[:-1])) if len(ends) else iter(())


def substring_dedup(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes or null).

    A byte is removed if a string of ``length`` bytes over it also starts in a document with a smaller
    doc_id. Null texts are empty; rows without a doc_id come after all others and take nothing from
    each other, as rows with equal doc_id do. Repeated rows are treated alike, texts shorter than
    ``length`` stay whole, an empty table gives an empty result.
    """
    if length < 2 * BLOCK:
        raise ValueError(f"length must be at least {2 * BLOCK}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("_id"), text.alias("_t"))
    # Zeros, which compress away, where the doc_id alone names the text.
    ids = keyed.where(f"_id <> {NO_ID}").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(stored(ids.select("_id", F.lit(True).alias("several")), "substring-ids"), "_id", "left")
    shared = (F.col("_id") == int(NO_ID)) | F.coalesce("several", F.lit(False))
    digests = [F.when(shared, h).otherwise(F.lit(0)).cast("long") for h in (F.xxhash64("_t"), F.xxhash64(F.lit(1), "_t"))]
    keyed = keyed.select("_id", digests[0].alias("_v"), digests[1].alias("_w"), "_t")
    marks = stored(settle(anchors(keyed, length)), "substring-places")
    some = marks.where(f"kind = {OPEN}").groupBy(*TEXT).agg(F.collect_set("pos").alias("places"))
    texts = zipped(keyed)
    todo = texts.join(some, TEXT).select(*TEXT, "z", "places")
    windows = stored(compared(strings(todo, length)), "substring-windows")
    all_ = marks.where(f"kind = {COVERED}").union(windows).groupBy(*TEXT)
    covers = all_.agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("pos"))).alias(n) for n, k in (("c", COVERED), ("w", WINDOW))])
    joined = texts.join(covers, TEXT, "left").select("_id", "z", "c", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for i, z, c, w in zip(batch.column(0).to_pylist(), batch.column(1), lists(batch.column(2)), lists(batch.column(3)), strict=True):
                data = unzip(z.as_py())
                edge = np.zeros(len(data) + 1, np.int32)
                lo, hi = np.maximum(0, c - (length - BLOCK)), np.minimum(len(data), c + length)
                lo, hi = lo[hi - lo >= length], hi[hi - lo >= length]
                for x, d in ((np.r_[lo, w], 1), (np.r_[hi, w + length], -1)):
                    np.add.at(edge, x, d)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((None if i == NO_ID else i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
