"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers of a document are its windows of five words, each with the number of its occurrence. A
sketch takes the few k-mers with the least hash and keeps them in text order, so that documents agree
on a sketch when they share these k-mers in the same order. Documents that agree on a sketch are
compared with one representative of it, then with all others of it that are not yet in their class;
similarity is edit similarity of the words, found by an alignment within a band of diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, stored

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
WORDS = 5
ROWS = 500
#: Hashes that are held at once while a text is sketched.
CELLS = 1 << 14
#: Members of a block of a bucket, and bits of the set that bounds what two texts can share.
BLOCK, BITS = 256, 2048
#: Texts that most rows hold: their rows are joined without a shuffle.
HOT = 1000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (lower case, ASCII white space between words)."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(~blank)
    size = stop - start
    place = np.arange(len(inside)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    powers = np.cumprod(np.full(int(size.max()), MIX2, np.uint64))
    return mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], np.r_[0, np.cumsum(size)[:-1]]))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of ``h`` with their occurrence number, so that they are unique."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    fresh = np.r_[True, s[1:] != s[:-1]] if n else np.empty(0, bool)
    if fresh.all():
        return h
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - begin).astype(np.uint64)
    return np.where(label > 0, mixed(h + label * MIX2), h)


def labelled_kmers(text: str | None, k: int = WORDS) -> np.ndarray:
    """Hashes of the windows of ``k`` words with their occurrence number; a shorter text is one window."""
    w = word_hashes(text)
    n = max(1, len(w) - k + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        h = h * MIX + w[j : j + n]
    return labelled(mixed(h))


def order_minhash(kmers: np.ndarray, sketches: int, per_sketch: int) -> np.ndarray:
    """One key per sketch: its least k-mers in text order.

    Many sketches are taken in one step, as many as keep the table of hashes at ``CELLS``.
    """
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * MIX)
    out = np.empty(sketches, np.uint64)
    take = min(per_sketch, len(kmers))
    step = max(1, CELLS // len(kmers))
    for at in range(0, sketches, step):
        seed = seeds[at : at + step]
        h = (kmers ^ seed[:, None]) * MIX
        h ^= h >> np.uint64(32)
        h *= MIX2
        key = seed
        for x in kmers[np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)].T:
            key = key * MIX + x
        out[at : at + step] = key
    return mixed(out)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The least number of words to insert, delete or replace between ``a`` and ``b``; None if over ``most``.

    The alignment keeps to the diagonals within ``most`` of the main one. A column of this band is one
    integer of vertical differences (a bit is a row), so that a column costs a few operations on it;
    from column to column the band moves down a row. Along its lower edge the cost is counted up, and
    in the last row to the end. Words that are frequent in the longer text have a bit set of their
    places, at most 512 of them; the places of the others are listed.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    most = min(most, m)
    if m - n > most:
        return None
    if not n:
        return m
    order = np.argsort(a, kind="stable")
    words, begin = np.unique(a[order], return_index=True)
    sets: dict[int, int] = {}
    lists: dict[int, list[int]] = {}
    wanted = set(b.tolist())
    for word, at in zip(words.tolist(), np.split(order, begin[1:]), strict=True):
        if word not in wanted:
            continue
        if len(at) > max(16, m // 512):
            held = np.zeros(m, bool)
            held[at] = True
            sets[word] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        else:
            lists[word] = at.tolist()
    width = 2 * most + 2
    full = (1 << width) - 1
    up, down = full ^ ((1 << (width - most - 1)) - 1), 0
    cost, edge, row = most, 1 << (width - 1), width - 2
    for j, word in enumerate(b.tolist()):
        top = j + most + 1 - width
        if word in sets:
            same = (sets[word] >> top if top >= 0 else sets[word] << -top) & full
        else:
            same = 0
            for p in lists.get(word, ()):
                if 0 <= p - top < width:
                    same |= 1 << (p - top)
        free = ((((same & up) + up) & full) ^ up) | same | down
        right, left = down | (full & ~(free | up)), free & up
        if j < m - most:
            cost += not free & edge
        else:
            cost += (right >> row & 1) - (left >> row & 1)
            row -= 1
        free >>= 1
        up, down = left | (full & ~(free | right)), free & right
        # Each column that is left can bring the cost down by one at most, and only in the last row.
        if cost - most > n - max(j + 1, m - most):
            return None
    return cost if cost <= most else None


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """One less the edits over the words of the longer text; 0 where it is below ``least``.

    The budget of edits that ``least`` leaves bounds the band. It is tried from a narrow band on, so
    that long texts with few edits cost little.
    """
    long = max(len(a), len(b))
    most = int(long * (1 - least) + 1e-9)
    if not long or abs(len(a) - len(b)) > most:
        return 0.0
    short = min(len(a), len(b))
    apart = np.flatnonzero(a[:short] != b[:short])
    head = int(apart[0]) if len(apart) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - short :] != b[len(b) - short :])
    tail = short - 1 - int(apart[-1]) if len(apart) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    # Words without a partner cost an edit each.
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    least_edits = max(len(a), len(b)) - common
    if least_edits > most:
        return 0.0
    band = min(most, max(32, 2 * least_edits))
    while True:
        edits = edits_within(a, b, band)
        if edits is not None:
            return 1 - edits / long
        if band == most:
            return 0.0
        band = min(most, 4 * band)


def sketches(docs: DataFrame, n: int, per_sketch: int) -> DataFrame:
    """``_id``, ``_th`` (text key) and ``keys`` for documents with a word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    kmers = [labelled_kmers(t) for t in part.column(2).to_pylist()]
                    keys = [order_minhash(k, n, per_sketch).view(np.int64) if len(k) else None for k in kmers]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_th", "keys"])

    return docs.select("_id", "_th", "_text").mapInArrow(sketch, "_id long, _th binary, keys array<long>")


def text_key(text: Column) -> Column:
    """A text by two 64-bit hashes: 16 bytes."""
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text))]
    return F.unhex(F.concat(*halves))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text_key(text).alias("_th"), text.alias("_text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs(a, b)`` of text keys with ``ok``: whether their edit similarity reaches ``least``."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ok = []
                last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    for b, x, y in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                        if last[0] != b:
                            last = (b, word_hashes(y))
                        ok.append(edit_similarity(word_hashes(x), last[1], least) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = texts.select(F.col("_th").alias("a"), F.col("_text").alias("x"))
    right = texts.select(F.col("_th").alias("b"), F.col("_text").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(align, "a binary, b binary, ok boolean")


def by_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``texts`` (one row per text key, ``n_same`` rows each).

    The ``HOT`` most repeated texts go to all tasks, so that no text that more than one in ``HOT`` rows
    holds is a key of the shuffle. The order by ``n_same`` and key makes the choice repeatable.
    """
    hot = stored(texts.where("n_same > 1").orderBy(F.desc("n_same"), "_th").limit(HOT), "near-repeated")
    near = rows.join(F.broadcast(hot), "_th")
    rest = rows.join(F.broadcast(hot.select("_th")), "_th", "left_anti").join(texts, "_th")
    return near.unionByName(rest)


def near_classes(docs: DataFrame, least: float = 0.8, n_sketches: int = 40, per_sketch: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rows as ``(_id, _th)`` and their texts as ``(_th, rep, n_same, root, n_links)``.

    ``rep`` is the smallest doc_id of a text, null where it has none, and ``root`` the least text key
    of its class.
    """
    keys = stored(sketches(keyed(docs), n_sketches, per_sketch), "near-sketches")
    # Equal texts are one text from here on, whatever their number.
    same = keys.groupBy("_th").agg(F.min("_id").alias("rep"), F.count("*").alias("n_same"), F.first("keys", ignorenulls=True).alias("keys"))
    same = stored(same, "near-texts")
    first, classes, across_ = linked(docs, same, least, n_sketches)
    links = first.union(across_)
    # Several texts under one doc_id are one document: all are tied to the least of them.
    rows = keys.select("_id", "_th")
    spread = rows.where("_id is not null").groupBy("_id").agg(F.min("_th").alias("b"), F.max("_th").alias("c")).where("b <> c")
    ids = rows.join(spread.select("_id", "b"), "_id").where("_th <> b").select(F.col("_th").alias("a"), "b").distinct()
    label = joined_classes(classes, across_.union(ids)).withColumnRenamed("node", "_th")
    both = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("_th")).agg(F.count("*").alias("n_links"))
    texts = same.drop("keys").join(label, "_th", "left").join(both, "_th", "left")
    return rows, stored(texts.select("_th", "rep", "n_same", F.coalesce("root", "_th").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "near-classes")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), n_links, n_same.

    ``n_links`` counts verified links of the row's text to other texts (two texts that other links
    tied together first are not compared), ``n_same`` the rows with the same text. Texts without a
    word are alike only if they are equal; null counts as empty. Rows without a doc_id take part like
    all others; class_id is null where no row of the class has one. Rows with equal doc_id are one
    document. Other columns are not read. An empty table gives an empty result.
    """
    rows, texts = near_classes(docs, **options)
    # Written first: a class of many texts can then be split in the join.
    class_id = stored(texts.groupBy("root").agg(F.min("rep").alias("class_id")), "near-roots")
    texts = stored(texts.join(class_id, "root").select("_th", "class_id", "n_links", "n_same"), "near-class-ids")
    return by_text(rows, texts).select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_same")


def bounds(texts: DataFrame) -> DataFrame:
    """``a``, the number ``m`` of words, and the set ``bits`` of their labelled hashes modulo ``BITS``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, sets = [], []
                for t in batch.column(1):
                    words = labelled(word_hashes(t.as_py()))
                    held = np.zeros(BITS, bool)
                    held[(words % np.uint64(BITS)).astype(np.int64)] = True
                    sizes.append(len(words))
                    sets.append(np.packbits(held).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], ["a", "m", "bits"])

    return texts.select("_th", "_text").mapInArrow(work, "a binary, m int, bits binary")


def met(x: np.ndarray, y: np.ndarray, s: int, roots: np.ndarray, m: np.ndarray, bits: np.ndarray, keys: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of the members ``x, y`` of a bucket of sketch ``s`` may be links of two classes.

    A pair is reported by the first sketch it shares only. Bits that one text alone has are words
    without a partner, each of which costs an edit, so a pair that is left out cannot reach ``least``.
    """
    at = np.flatnonzero(roots[x] != roots[y])
    if s:
        at = at[~(keys[x[at], :s] == keys[y[at], :s]).any(axis=1)]
    x, y = x[at], y[at]
    most = m[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64)
    most = np.minimum(most, m[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64))
    return at[most >= least * np.maximum(m[x], m[y]) - 1e-9]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of ``key, i, j``, as tables that cut no group in two."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    # A group can go on in the next batch: its rows are held until it ends.
    for batch in batches:
        group = [batch.column(c).to_pylist() for c in range(3)]
        group = list(zip(*group, strict=True))
        ends = [k for k, g in enumerate(group) if g != (group[k - 1] if k else last)]
        if not ends:
            held.append(batch)
            continue
        held.append(batch.slice(0, ends[-1]))
        if sum(h.num_rows for h in held):
            yield pa.Table.from_batches(held).combine_chunks()
        held, last = [batch.slice(ends[-1])], group[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def meetings(table: pa.Table, least: float, n_sketches: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The start of each group of ``table`` with rows ``x, y`` of it that may be links, in several parts."""

    def numbers(name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.int64)

    key, first, second, own, m, s = (numbers(c) for c in ("key", "i", "j", "own", "m", "s"))
    roots = pa.concat_arrays(table.column("root").chunks).dictionary_encode().indices.to_numpy()
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
    keys = pa.concat_arrays(table.column("keys").chunks).flatten().to_numpy().reshape(len(key), n_sketches)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    for lo, hi in zip(start, np.r_[start[1:], len(key)], strict=True):
        row = np.arange(lo, hi)
        same = first[lo] == second[lo]
        left, right = (row, row) if same else (row[own[lo:hi] == first[lo]], row[own[lo:hi] == second[lo]])
        for at in range(0, len(left), 32):
            x, y = (g.ravel() for g in np.meshgrid(left[at : at + 32], right, indexing="ij"))
            if same:
                x, y = x[x < y], y[x < y]
            pick = met(x, y, int(s[lo]), roots, m, bits, keys, least)
            if len(pick):
                yield int(lo), x[pick], y[pick]


def across(members: DataFrame, texts: DataFrame, least: float, n_sketches: int) -> DataFrame:
    """Links ``a, b`` between members of one bucket and different classes, ``b`` the smaller.

    A bucket is cut into blocks; each pair of blocks is compared where its key puts it, so the
    members of a large bucket spread over many tasks. A first pass leaves the members that may have a
    link; these get their texts and are aligned in their blocks. Pairs never become rows before they
    are links: a text is sent once for each pair of blocks, not for each pair of texts.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "s", "own", "a", "root", "m", "bits", "keys")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            found = np.zeros(table.num_rows, bool)
            for _, x, y in meetings(table, least, n_sketches):
                found[x] = found[y] = True
            yield from table.filter(pa.array(found)).to_batches()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for table in whole_groups(batches):
                ids, text = (pa.concat_arrays(table.column(c).chunks) for c in ("a", "_text"))
                group, words = None, {}
                for lo, x, y in meetings(table, least, n_sketches):
                    if lo != group:
                        group, words = lo, {}
                    for k in {*x.tolist(), *y.tolist()} - words.keys():
                        h = word_hashes(text[k].as_py())
                        words[k] = h, np.sort(labelled(h))
                    ok = [linkable(*words[i], *words[j], least) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                    if any(ok):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(g[ok])) for g in (x, y)], ["a", "b"])

    found = stored(grouped(cut).mapInArrow(open_, cut.schema), "near-across")
    named = found.join(texts.withColumnRenamed("_th", "a"), "a").select(*cut.columns, "_text")
    pairs = grouped(named).mapInArrow(align, "a binary, b binary")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def linkable(a: np.ndarray, bag_a: np.ndarray, b: np.ndarray, bag_b: np.ndarray, least: float) -> bool:
    """Whether two texts reach ``least``; words without a partner in the other bag settle most pairs."""
    long = max(len(a), len(b))
    both = np.concatenate((bag_a, bag_b))
    both.sort(kind="stable")
    if long - np.count_nonzero(both[1:] == both[:-1]) > int(long * (1 - least) + 1e-9):
        return False
    return edit_similarity(a, b, least) >= least


def linked(docs: DataFrame, same: DataFrame, least: float, n_sketches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links ``a, b`` between text keys, ``b`` the smaller: those to the representative of a
    bucket, the classes ``(node, root)`` that these make, and the links between such classes.

    Any two texts that share a sketch and reach ``least`` are tied together: each text is compared with
    one representative of its buckets, and texts of different classes in a bucket with each other.
    """
    spread = same.where("keys is not null").select(F.col("_th").alias("a"), "keys")
    rows = spread.select("a", F.posexplode("keys").alias("s", "key"))
    # Only sketches that two texts share go on; counts are combined before the shuffle.
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(rows.join(shared, "key").select("a", "key", "s", "n"), "near-members")
    # The text that meets most others speaks for a bucket: an original with edited copies links them.
    weight = stored(members.groupBy("a").agg(F.sum("n").alias("w")), "near-weights")
    lead = members.join(weight, "a").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "a"))["a"].alias("lead"))
    first = members.join(lead, "key").where("a <> lead").select(F.greatest("a", "lead").alias("a"), F.least("a", "lead").alias("b")).distinct()
    # Equal texts are combined before the shuffle, so that a hot one is one row per task.
    wanted = weight.select(F.col("a").alias("_th"))
    once = by_text(keyed(docs), same.select("_th", "rep", "n_same").join(wanted, "_th", "left_semi")).where("_id <=> rep")
    texts = stored(once.groupBy("_th").agg(F.first("_text").alias("_text")), "near-candidate-texts")
    done = stored(verified(first, texts, least), "near-verified").where("ok").select("a", "b")
    classes = components(done, "near-first")
    label = classes.withColumnRenamed("node", "a")
    rooted = stored(members.join(label, "a", "left").select("a", "key", "s", "n", F.coalesce("root", "a").alias("root")), "near-rooted")
    # Buckets of one class are settled; in the others all members stay, linked or not.
    mixed_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = stored(rooted.join(mixed_, "key", "left_semi"), "near-open")
    whole = bounds(texts.join(left.select(F.col("a").alias("_th")).distinct(), "_th", "left_semi")).join(spread.select("a", "keys"), "a")
    rest = stored(across(left.join(whole, "a"), texts, least, n_sketches), "near-verified-across")
    return done, classes, rest


def joined_classes(classes: DataFrame, more: DataFrame) -> DataFrame:
    """``classes(node, root)`` tied together by the links ``more(a, b)``, whose ends may be new nodes.

    Only the links between the roots go through all rounds again.
    """
    own = classes.select(F.col("node").alias("a"), F.col("root").alias("x"))
    other = classes.select(F.col("node").alias("b"), F.col("root").alias("y"))
    ends = more.join(own, "a", "left").join(other, "b", "left")
    roots = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), "near")
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = classes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.union(roots.join(classes.select("node"), "node", "left_anti").select("node", "root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, all columns kept.

    The row with the smallest doc_id stays; between texts of one doc_id, and in classes without any,
    the one with the least text key. Of equal rows of it one stays.
    """
    rows, texts = near_classes(docs.select("doc_id", "text"), **options)
    kept = texts.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "_th")).alias("k"))
    kept = stored(kept.select(F.col("k._th").alias("_th"), F.col("k.rep").alias("_k")), "near-kept")

    def row_key(text: Column, doc_id: Column) -> Column:
        return text_key(F.concat_ws("-", F.hex(text), doc_id.cast("string"))).alias("_th")

    # Rows are found by text and doc_id together, so that copies of a text under other ids spread.
    # Equal rows are counted first: only repeated ones are sorted out by key.
    once = rows.groupBy("_th", "_id").agg(F.count("*").alias("n_same"))
    once = once.join(kept, (once["_th"] == kept["_th"]) & once["_id"].eqNullSafe(kept["_k"]))
    once = stored(once.select(row_key(kept["_th"], F.col("_k")), "n_same"), "near-kept-once")
    packed = docs.select(F.struct("*").alias("_row"))
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    found = by_text(packed.select("_row", row_key(text_key(text), F.col("_row.doc_id").cast("long"))), once)
    several = found.where("n_same > 1").dropDuplicates(["_th"])
    return found.where("n_same = 1").select("_row").union(several.select("_row")).select("_row.*")
