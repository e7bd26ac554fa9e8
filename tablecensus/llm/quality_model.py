"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and counts that Spark computes from the text. Shallow trees are boosted in turn
on one feature at a time, then on the most useful pairs, and end up as lookup tables: a score is the
sum of one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import CLASSES, with_counts
from .shared import stored

FEATURES = ("words", "word_length", *(c for c, _ in CLASSES), "other", "dup_lines", "repeats", "common")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, an array of one double per feature; only the text is read."""
    counted = with_counts(docs.select("doc_id", "text", F.lit("en").alias("lang")))
    words = F.greatest(F.col("_q.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("_q.word_chars"), F.lit(1)).cast("double")
    x = [F.log1p("_q.n_words"), F.col("_q.word_chars") / words]
    x += [F.col("_q.classes")[i] / chars for i in range(len(CLASSES) + 1)]
    x += [F.log1p("_q.n_dup_lines"), F.col("_q.n_repeat_words") / words]
    x += [F.aggregate("_q.common", F.lit(0).cast("long"), lambda a, b: a + b) / words]
    return counted.select("doc_id", F.array(*[c.cast("double") for c in x]).alias("x"))


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        wide = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for j in {j for p in self.pairs for j in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[wide[i], wide[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(np.nan_to_num(x)), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf value of each bin: the bins are split in order, best gain first, into a few leaves."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    parts = [(0, len(g))]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                top = int(gain.argmax())
                best = max(best, (float(gain[top]), (a, b), int(k[top])), key=lambda t: t[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 5, leaves: int = 4, l2: float = 5.0) -> AdditiveModel:
    """Cyclic boosting with logistic loss; without both labels the model is a constant."""
    d = len(FEATURES)
    n1, n = float(y.sum()), len(y)
    start = float(np.log((n1 + 1) / (n - n1 + 1)))
    edges = [quantile_edges(x[:, j], bins) if n else np.empty(0) for j in range(d)]
    coarse = [quantile_edges(x[:, j], 8) if n else np.empty(0) for j in range(d)]
    model = AdditiveModel(edges, coarse, start, [np.zeros(len(e) + 1) for e in edges])
    if not 0 < n1 < n:
        return model
    place = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(n, start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = gradients()
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(place[j], g, size), np.bincount(place[j], h, size), leaves, l2)
            model.tables[j] += step
            f += step[place[j]]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def cells(i: int, j: int) -> tuple[np.ndarray, int, int]:
        return wide[i] * (len(coarse[j]) + 1) + wide[j], len(coarse[i]) + 1, len(coarse[j]) + 1

    g, h = gradients()
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            at, a, b = cells(i, j)
            gains.append((float((np.bincount(at, g, a * b) ** 2 / (np.bincount(at, h, a * b) + l2)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradients()
            at, a, b = cells(i, j)
            gs, hs = np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b)
            # A tree of depth two: one split of the first feature, then the second in each half.
            cut = np.flatnonzero(np.diff(shallow_tree(gs.sum(1), hs.sum(1), 2, l2))) + 1
            step = np.zeros((a, b))
            for rows in np.split(np.arange(a), cut):
                step[rows] = rate * shallow_tree(gs[rows].sum(0), hs[rows].sum(0), leaves, l2)
            model.pair_tables[k] += step
            f += step.ravel()[at]
    return model


def training_rows(features: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out part, chosen by a hash of the id."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(f"y in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return features.join(F.broadcast(known), "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The model is fitted on the driver from the features of at most ``max_train_rows`` labelled rows.
    Labels other than 0 and 1 and null ids are not learned from, of conflicting labels 0 counts;
    without both labels all scores are the share of label 1. Null and empty texts are scored by their
    zero counts. Of several texts under one labelled id the one with the least features is learned from.
    Repeated rows are scored each for itself; empty tables give empty results.
    """
    features = stored(with_features(docs), "quality-features")
    # Of several texts under one labelled id always the same one.
    known = training_rows(features, labels, "quality", max_train_rows)
    rows = known.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y").collect()
    rows.sort(key=lambda r: (list(r.x), r.y))
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    model = fit(x, np.array([r.y for r in rows], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = features.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "x")
    return narrow.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
