"""Hard negatives by Strassen multiplication of int64 anchor and candidate tiles.

Every anchor meets every candidate, in tiles: anchors are dealt into bands, candidates into strips of
bounded size, and one task multiplies one band with one strip. A tile keeps only the heap of each
anchor (its best rows of the same label) or of each anchor and positive (its best rows inside the
window of scores); the heaps of all strips are merged by a limit that Spark applies before and after
the shuffle. The first round finds positives, the second one, with their windows, negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows of a strip and anchors of a band, on average; both are dealt by a hash of the whole row.
STRIP, BAND = 8192, 4096
#: Candidates and anchors that are multiplied at once.
TILE = 1024
#: Below this many rows, columns or entries a product is formed directly.
LEAF = 24
NO_ID = np.iinfo(np.int64).max


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or null or non-finite entries take no part, nor do rows
    of another length than most (of equally frequent lengths the longer counts). Rows equal in id,
    label and vector count once. Other rows under one id are anchors and candidates of their own,
    but none is a positive of the other. A row without an id is never an anchor and comes last among
    equal scores. Other columns are ignored; an empty table, no anchor, no positive or no negative
    inside the window give no row. An entry or score beyond 64 bits fails instead of wrapping.
    """
    rows = usable(embeddings)
    # One small row per length that occurs at all.
    length = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a"), F.max("top").alias("top"))
    length = length.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not length or not length[0]["d"]:
        return rows.sparkSession.createDataFrame([], empty)
    d, n, n_anchors, top = length[0]
    if top >= 2.0**53 or d * top * top >= 2.0**62:
        raise OverflowError("A score is too large for a 64-bit integer.")
    rows = rows.where(F.col("d") == d)
    strips, bands = -(-n // STRIP), max(1, -(-n_anchors // BAND))
    anchors = rows.where(F.col("vec_id") % every == 0)
    positive = stored(positives_of(anchors, rows, d, strips, bands, positives), "negatives-positives")
    # The lists of one anchor are as long as the number of positives.
    windows = positive.groupBy("key").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    found = negatives_of(anchors.join(windows, "key"), rows, d, strips, bands, negatives)
    found = found.withColumnRenamed("score", "negative_score").withColumnRenamed("other_id", "negative_id")
    # Positives of one score share their window, so that scores stand for positives.
    pairs = positive.withColumnRenamed("score", "positive_score").withColumnRenamed("other_id", "positive_id")
    pairs = pairs.join(found, ["key", "positive_score"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(embeddings: DataFrame) -> DataFrame:
    """key, vec_id, label and whole entries of the rows that take part, each once; written once."""
    x, id_ = F.col("embedding"), F.col("vec_id").cast("long")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    rows = embeddings.where(x.isNotNull() & F.col("label").isNotNull() & sound).select(id_.alias("vec_id"), moved.alias("label"), whole.alias("x"))
    biggest = F.coalesce(F.array_max(F.transform(F.col("x"), lambda c: F.abs(c.cast("double")))), F.lit(0.0))
    rows = rows.distinct().select(
        # Two hashes of the whole row: which row, and where it is dealt to.
        F.struct(F.xxhash64("vec_id", "label", "x").alias("p"), F.xxhash64("x", F.lit(1), "label", "vec_id").alias("q")).alias("key"),
        "vec_id", "label", F.size("x").alias("d"), biggest.alias("top"), "x",
    )
    return stored(rows, "negatives-rows")


def tiles(anchors: DataFrame, rows: DataFrame, strips: int, bands: int):
    """Each band beside each strip: anchors are copied to all strips, candidates to all bands."""
    band, strip = F.pmod(F.col("key.p"), F.lit(bands)).cast("int"), F.pmod(F.col("key.q"), F.lit(strips)).cast("int")
    left = anchors.select(band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "*")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), strip.alias("strip"), *[F.col(c).alias(f"other_{c}") for c in ("vec_id", "label", "x")])
    return left.groupBy("band", "strip").cogroup(right.groupBy("band", "strip"))


def positives_of(anchors: DataFrame, rows: DataFrame, d: int, strips: int, bands: int, limit: int) -> DataFrame:
    """key, anchor_id, other_id, score of the best ``limit`` other rows of each anchor's label."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return heap_table(left, "p q anchor_id", None)
        a, b = Side(left, "", d), Side(right, "other_", d)
        heap = Heap(limit)
        for i, j, scores in products(a.x, b.x):
            other = (a.label[i][:, None] == b.label[j]) & (a.ids[i][:, None] != b.ids[j])
            heap.add(np.arange(i.start, i.stop), scores, b.ids[j], other)
        return heap_table(left, "p q anchor_id", heap)

    left = anchors.select("key", "vec_id", "label", "x")
    merged = tiles(left, rows, strips, bands).applyInArrow(best, "p long, q long, anchor_id long, other_id long, score long")
    merged = merged.select(F.struct("p", "q").alias("key"), "anchor_id", F.nullif("other_id", F.lit(NO_ID)).alias("other_id"), "score")
    return merged_heaps(merged, ["key"], limit).drop("rank")


def negatives_of(anchors: DataFrame, rows: DataFrame, d: int, strips: int, bands: int, limit: int) -> DataFrame:
    """key, positive_score, rank, other_id, score of the best ``limit`` rows of other labels in each window."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return heap_table(left, "p q positive_score", None)
        a, b = Side(left, "", d), Side(right, "other_", d)
        # One heap per window: an anchor's distinct positive scores.
        scores_of = [np.unique(s) for s in left.column("scores").to_pylist()]
        owner = np.repeat(np.arange(len(a.ids)), [len(s) for s in scores_of])
        high = np.concatenate(scores_of)
        low = high - high // 5
        heap = Heap(limit)
        for i, j, scores in products(a.x, b.x):
            w = np.flatnonzero((owner >= i.start) & (owner < i.stop))
            row = owner[w] - i.start
            inside = scores[row]
            fits = (a.label[owner[w]][:, None] != b.label[j]) & (inside >= low[w, None]) & (inside <= high[w, None])
            heap.add(w, inside, b.ids[j], fits)
        return heap_table(left.take(pa.array(owner)), "p q positive_score", heap, high)

    left = anchors.select("key", "vec_id", "label", "x", "scores")
    merged = tiles(left, rows, strips, bands).applyInArrow(best, "p long, q long, positive_score long, other_id long, score long")
    merged = merged.select(F.struct("p", "q").alias("key"), "positive_score", F.nullif("other_id", F.lit(NO_ID)).alias("other_id"), "score")
    return merged_heaps(merged, ["key", "positive_score"], limit)


def merged_heaps(heaps: DataFrame, owner: list[str], limit: int) -> DataFrame:
    """The best ``limit`` of all heaps of one owner; Spark applies the limit in every task first."""
    order = Window.partitionBy(*owner).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


class Side:
    """Ids, labels and integer vectors of one side of a tile."""

    def __init__(self, table: pa.Table, prefix: str, d: int):
        self.ids = table.column(f"{prefix}vec_id").fill_null(NO_ID).to_numpy()
        self.label = table.column(f"{prefix}label").to_numpy()
        self.x = table.column(f"{prefix}x").combine_chunks().flatten().to_numpy().reshape(-1, d)


class Heap:
    """The best few of each owner by score, then smaller id; adding a block merges it in."""

    def __init__(self, limit: int):
        self.limit, self.pending = limit, []

    def add(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Candidates ``ids`` with a row of scores for each of ``owners``; only those that fit count."""
        if scores.shape[1] > self.limit and len(scores):
            # What is worse than the last place of its row in this block needs no sorting.
            able = np.where(fits, scores, np.iinfo(np.int64).min)
            fits = fits & (able >= np.partition(able, -self.limit, axis=1)[:, -self.limit, None])
        row, column = np.nonzero(fits)
        if len(row):
            self.pending.append(self.cut(owners[row], scores[row, column], ids[column]))
        if sum(len(p[0]) for p in self.pending) > 1 << 20:
            self.merge()

    def cut(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray):
        order = np.lexsort((id_, -score, owner))
        owner, score, id_ = owner[order], score[order], id_[order]
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
        best = place < self.limit
        return owner[best], score[best], id_[best]

    def merge(self):
        """Owner, score and id of all that is left."""
        if not self.pending:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pending = [self.cut(*(np.concatenate(c) for c in zip(*self.pending, strict=True)))]
        return self.pending[0]


def heap_table(left: pa.Table, names: str, heap: Heap | None, high: np.ndarray | None = None) -> pa.Table:
    owner, score, id_ = heap.merge() if heap else (np.zeros(0, np.int64),) * 3
    key = left.column("key").combine_chunks()
    columns = [key.field("p"), key.field("q"), left.column("vec_id") if high is None else pa.array(high)]
    columns = [c.take(pa.array(owner)) for c in columns]
    return pa.table([*columns, pa.array(id_), pa.array(score)], names=[*names.split(), "other_id", "score"])


def products(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks of a bᵀ, each with the rows and columns that it covers."""
    for j in range(0, len(b), TILE):
        right = np.ascontiguousarray(b[j : j + TILE].T)
        for i in range(0, len(a), TILE):
            left = a[i : i + TILE]
            yield slice(i, i + len(left)), slice(j, j + right.shape[1]), strassen(left, right)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of two int64 matrices by seven half-sized ones; odd sizes are padded with zeros."""
    n, m, k = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m, k) <= LEAF:
        return np.einsum("ij,jk->ik", a, b)
    if n % 2 or m % 2 or k % 2:
        padded = strassen(np.pad(a, ((0, n % 2), (0, m % 2))), np.pad(b, ((0, m % 2), (0, k % 2))))
        return padded[:n, :k]
    n, m, k = n // 2, m // 2, k // 2
    a11, a12, a21, a22 = a[:n, :m], a[:n, m:], a[n:, :m], a[n:, m:]
    b11, b12, b21, b22 = b[:m, :k], b[:m, k:], b[m:, :k], b[m:, k:]
    out = np.empty((2 * n, 2 * k), np.int64)
    c11, c12, c21, c22 = out[:n, :k], out[:n, k:], out[n:, :k], out[n:, k:]
    p = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out
