"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary holds the words whose presence depends on the label in the labelled sample; document
frequencies are counted over all documents. Examples lie in blocks with the largest weight of each
word; blocks whose bound cannot reach the current best neighbours are never scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import held_out
from .shared import stored

WORD_BREAK = r"[^\p{L}]+"
BLOCK = 64
FIRST_BLOCKS = 8
#: A word is frequent if more than one of this many examples holds it.
FREQUENT = 16
#: Texts that are scored together.
TOGETHER = 32


def words_of(text: str = "text"):
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), WORD_BREAK), "")


def vocabulary(sample: DataFrame, max_words: int, least: float, support: int) -> list[str]:
    """Words of ``sample(text, y)`` with the largest chi-squared statistic of presence and label."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = totals["n"], totals["n1"] or 0
    if not 0 < n1 < n:
        return []
    seen = sample.select("y", F.explode(F.array_distinct(words_of())).alias("w"))
    seen = seen.groupBy("w").agg(F.count("*").alias("a"), F.sum("y").alias("b")).where(F.col("a") >= support)
    a, b, n_, n1_ = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(n)), F.lit(float(n1))
    off = F.greatest(F.lit(0.0), F.abs(b * n_ - a * n1_) - n_ / 2)
    chi = off * off * n_ / n_ / (a * (n_ - a) * n1_ * (n_ - n1_) / n_)
    top = seen.withColumn("chi", chi).where(F.col("chi") >= least).orderBy(F.desc("chi"), "w").limit(max_words)
    return [r["w"] for r in top.collect()]


class BlockMaxIndex:
    """Unit vectors of the examples in blocks, with the largest weight of each word per block.

    Equal vectors are one entry with several members (label and id), so that a text meets each
    vector once, however many examples share it.
    """

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list[int]):
        # Like vectors lie together, so that a block's bounds are close to its members' weights.
        shape = [tuple(sorted(v.items(), key=lambda t: (-t[1], t[0]))) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (shape[i], ids[i]))
        fresh = [at for at, i in enumerate(order) if at == 0 or shape[i] != shape[order[at - 1]]]
        self.labels = np.array([labels[i] for i in order], float)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.members = np.array([*fresh, len(order)], np.int64)
        self.copies = np.diff(self.members)
        self.entry_of = dict(zip(self.ids.tolist(), np.repeat(np.arange(len(fresh)), self.copies).tolist(), strict=True))
        self.blocks = max(1, -(-len(fresh) // BLOCK))
        flat = [(t, at, w) for at, i in enumerate(fresh) for t, w in shape[order[i]]]
        term, place = np.array([f[0] for f in flat], np.int64), np.array([f[1] for f in flat], np.int64)
        weight, by_term = np.array([f[2] for f in flat], float), np.lexsort((place, term))
        self.places, self.weights, term = place[by_term], weight[by_term], term[by_term]
        # One entry per word and block: its block, first posting, number of postings, largest weight.
        pair, self.first, self.size = np.unique(term * self.blocks + self.places // BLOCK, return_index=True, return_counts=True)
        self.block = pair % self.blocks
        self.largest = np.maximum.reduceat(self.weights, self.first) if len(pair) else np.empty(0)
        # Entries of word t lie between starts[t] and starts[t + 1].
        self.starts = np.searchsorted(pair // self.blocks, np.arange(int(term.max(initial=-1)) + 2))
        # Frequent words as columns of a matrix: adding them up there is cheaper than by postings.
        n = np.bincount(term, minlength=1)
        self.column = np.where(n * FREQUENT > len(fresh), np.cumsum(n * FREQUENT > len(fresh)) - 1, -1)
        self.dense = np.zeros((self.column.max() + 1, self.blocks * BLOCK))
        often = self.column[term] >= 0 if len(term) else np.zeros(0, bool)
        self.dense[self.column[term[often]], self.places[often]] = self.weights[often]

    @staticmethod
    def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)

    def nearest(self, queries: list[dict[int, float]], k: int, skip: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` nearest examples with positive cosine: cosines and places of members; ties by place."""
        used = [(i, t, w) for i, query in enumerate(queries) for t, w in query.items() if t + 1 < len(self.starts)]
        q, terms = np.array([u[0] for u in used], np.int64), np.array([u[1] for u in used], np.int64)
        n = self.starts[terms + 1] - self.starts[terms]
        entries = self.ranges(self.starts[terms], n)
        w = np.repeat(np.array([u[2] for u in used], float), n)
        # The blocks of query i have the numbers from i * blocks on.
        block = np.repeat(q, n) * self.blocks + self.block[entries]
        bound = np.bincount(block, w * self.largest[entries], len(queries) * self.blocks).reshape(-1, self.blocks)
        often = self.column[terms] >= 0 if len(terms) else np.zeros(0, bool)
        mass = np.zeros((len(queries), len(self.dense)))
        mass[q[often], self.column[terms[often]]] = np.array([u[2] for u in used], float)[often]
        frequent = (mass @ self.dense).reshape(*bound.shape, BLOCK)
        rare = np.repeat(~often, n)
        own = np.array([self.entry_of.get(i, -1) for i in skip], np.int64)
        floor = np.zeros(len(queries))
        found_q, found_s, found_i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        # The best blocks give a k-th cosine; then all blocks whose bound reaches it are scored at once.
        best = np.zeros(bound.shape, bool)
        np.put_along_axis(best, np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        for step in range(2):
            live = (best if step == 0 else ~best) & (bound > 0) & (bound + 1e-9 >= floor[:, None])
            if not live.any():
                continue
            read = live.ravel()[block] & rare
            size = self.size[entries[read]]
            posting = self.ranges(self.first[entries[read]], size)
            # The sums lie side by side for the live blocks only.
            slot = np.repeat((np.cumsum(live.ravel()) - 1)[block[read]], size)
            s = np.bincount(slot * BLOCK + self.places[posting] % BLOCK, np.repeat(w[read], size) * self.weights[posting], live.sum() * BLOCK)
            s = s + frequent[live].ravel()
            hit = np.flatnonzero(s > 0)
            number = np.flatnonzero(live)[hit // BLOCK]
            # Equal vectors differ by rounding only: compare what is left after that.
            s, at, place = np.round(s[hit], 9), number // self.blocks, number % self.blocks * BLOCK + hit % BLOCK
            near = s >= floor[at]
            at, s, place = np.r_[found_q, at[near]], np.r_[found_s, s[near]], np.r_[found_i, place[near]]
            order = np.lexsort((place, -s, at))
            at, s, place = at[order], s[order], place[order]
            copies = self.copies[place] - (place == own[at])
            begin = np.searchsorted(at, np.arange(len(queries) + 1))
            total = np.r_[0, np.cumsum(copies)]
            before = total[:-1] - total[begin[:-1]][at]
            top = before < k
            found_q, found_s, found_i = at[top], s[top], place[top]
            full = top & (before + copies >= k)
            floor[at[full]] = s[full]
        size = self.copies[found_i]
        at, s, q = self.ranges(self.members[found_i], size), np.repeat(found_s, size), np.repeat(found_q, size)
        other = np.repeat(found_i != own[found_q], size) | (self.ids[at] != np.array([-1 if i is None else i for i in skip])[q])
        at, s, q = at[other], s[other], q[other]
        begin = np.searchsorted(q, np.arange(len(queries) + 1)).tolist()
        return [(s[i:j][:k], at[i:j][:k]) for i, j in zip(begin, begin[1:], strict=False)]


class Voter:
    """Distance-weighted votes of the nearest examples, calibrated on the examples themselves."""

    def __init__(self, index: BlockMaxIndex, idf: np.ndarray, k: int, base: float, empty: float):
        self.index, self.idf, self.k, self.base, self.empty = index, idf, k, base, empty
        self.slope, self.shift = 1.0, 0.0

    def unit(self, terms: list[int] | np.ndarray) -> dict[int, float]:
        v = {t: (1 + np.log(c)) * self.idf[t] for t, c in sorted(Counter(terms).items())}
        size = np.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()} if size > 0 else {}

    def votes(self, queries: list[dict[int, float]], skip: list[int | None] | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """The vote on each query and the ids of its neighbours."""
        skip = skip or [None] * len(queries)
        for start in range(0, len(queries), TOGETHER):
            part = slice(start, start + TOGETHER)
            for s, at in self.index.nearest(queries[part], self.k, skip[part]):
                weight = s**4
                yield float((weight @ self.index.labels[at] + self.base * 0.5) / (weight.sum() + 0.5)), self.index.ids[at]

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the labels on the log odds of the votes (ridge, Newton steps)."""
        z = np.log(votes / (1 - votes))
        w = np.array([0.0, 1.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * z, -30, 30)))
            x = np.c_[np.ones_like(z), z]
            grad = x.T @ (labels - p) - 1e-2 * (w - [0, 1])
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        self.shift, self.slope = float(w[0]), max(float(w[1]), 1e-3)

    def score(self, texts: list[tuple[int, ...]]) -> list[tuple[float, list[int]]]:
        """Scores and near examples of texts given by the numbers of their words."""
        queries = [self.unit(terms) for terms in texts]
        out: list[tuple[float, list[int]]] = [(self.empty, [])] * len(texts)
        some = [i for i, query in enumerate(queries) if query]
        for i, (v, ids) in zip(some, self.votes([queries[i] for i in some]), strict=True):
            out[i] = float(1 / (1 + np.exp(-(self.shift + self.slope * np.log(v / (1 - v)))))), [int(x) for x in ids[:5]]
        return out


def toxicity(
    docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, max_words: int = 2048, k: int = 25,
    least_chi: float = 16.0, support: int = 4, threshold: float = 0.5,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (ids of near examples).

    At most ``max_train_rows`` labelled rows are learned from; document frequencies cover all rows.
    Labels other than 0 and 1 and null ids are not learned from, of conflicting labels 0 counts. A
    text without a word of the vocabulary (null and empty ones too) gets the smoothed share of toxic
    examples among such texts, without both labels every text does. Of several texts under one labelled
    id the one with the least hash is learned from. Repeated rows are scored each for
    itself; empty tables give empty results.
    """
    known = labels.select("doc_id", F.col("toxic").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    known = stored(known, "toxicity-labels")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # Of several texts under one id always the same one.
    one = sample.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    sample = stored(one.select("doc_id", F.col("t.text").alias("text"), "y"), "toxicity-sample")
    words = vocabulary(sample, max_words, least_chi, support)
    place = {w: i for i, w in enumerate(words)}

    def numbered(df: DataFrame) -> DataFrame:
        if not words:
            return df.select("doc_id", F.array().cast("array<string>").alias("terms"))
        return df.select("doc_id", F.filter(words_of(), lambda w: w.isin(*words)).alias("terms"))

    vectors = stored(numbered(docs.select("doc_id", "text")), "toxicity-terms")
    n = vectors.count()
    df = vectors.select(F.explode(F.array_distinct("terms")).alias("w")).groupBy("w").count()
    counts = dict.fromkeys(words, 0) | {r["w"]: r["count"] for r in df.collect()}
    idf = np.array([np.log((n + 1) / (counts[w] + 1)) + 1 for w in words])
    rows = sorted(numbered(sample).join(known, "doc_id").collect(), key=lambda r: r["doc_id"])
    filled = [r for r in rows if r["terms"]]
    y = np.array([r["y"] for r in filled], float)
    bare = [r["y"] for r in rows if not r["terms"]]
    share = (sum(r["y"] for r in rows) + 0.5) / (len(rows) + 1) if rows else 0.5
    empty = (sum(bare) + share) / (len(bare) + 1)
    voter = Voter(BlockMaxIndex([], [], []), idf, k, float(np.clip(share, 1e-3, 1 - 1e-3)), empty)
    units = [voter.unit([place[w] for w in r["terms"]]) for r in filled]
    voter.index = BlockMaxIndex(units, [r["y"] for r in filled], [r["doc_id"] for r in filled])
    if len(set(y)) == 2:
        voter.calibrate(np.array([v for v, _ in voter.votes(units, [r["doc_id"] for r in filled])]), y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_scores: dict[tuple, tuple[float, list[int]]] = {}
        for batch in batches:
            keys = [tuple(sorted(place[w] for w in terms)) for terms in batch.column(2).to_pylist()]
            if len(known_scores) > 50_000:
                known_scores.clear()
            fresh = [key for key in dict.fromkeys(keys) if key not in known_scores]
            known_scores.update(zip(fresh, voter.score(fresh), strict=True))
            out = [known_scores[key] for key in keys]
            s = np.array([a for a, _ in out], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([b for _, b in out], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    narrow = vectors.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "terms")
    # The small table lies in few files: deal its rows over all cores.
    dealt = narrow.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
