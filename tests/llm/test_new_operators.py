"""Whitening, personal data and hard negatives against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecensus.llm import hard_negatives, personal_data, toxicity, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def clouds(n, d, seed):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(2, 0.1, d) + r.standard_normal(d)).astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "d", "components", "guard"), [(300, 20, 6, 4), (40, 5, 32, 24), (3, 8, 32, 0)])
def test_whitening_equals_a_full_decomposition(spark, n, d, components, guard):
    rows = [(i, v, 0) for i, v in enumerate(clouds(n, d, n))]
    out = whitening.whiten(spark.createDataFrame(rows, EMBEDDINGS).repartition(4), components, guard).collect()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    k = min(components, d, n - 1)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(out) == n * k
    got = np.empty((n, k))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], x.sum(axis=0), strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
    want = centred @ vectors / np.sqrt(values)
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-7


def test_whitening_of_odd_rows(spark):
    good = [(i, v, 0) for i, v in enumerate(clouds(50, 4, 1))]
    odd = [(1, None, 0), (2, [], 0), (3, [1.0, None, 2.0, 3.0], 0), (4, [1.0, float("nan"), 2.0, 3.0], 0), (5, [float("-inf")] * 4, 0), (6, [1.0], 0)]
    odd += [good[7], (None, good[8][1], None)]
    df = spark.createDataFrame(good + odd, EMBEDDINGS).withColumns({"d": F.lit(1), "x": F.lit("y"), "n": F.lit(2), "a.b": F.lit(3)})
    out = whitening.whiten(df, 3, 0).collect()
    assert len(out) == 52 * 3
    assert {r.n for r in out} == {52}
    assert sum(r.vec_id == 7 for r in out) == 6
    assert sum(r.vec_id is None for r in out) == 3
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 7")).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if valid[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans_equal_the_patterns(spark, documents):
    r, texts = random.Random(4), [None, "", "a@b.c@d.e x@y", "1.2.3.4.5.6.7.8", "+1 (555) 555-0199.", "4539 1488 0343 6467", "é٣@a.b"]
    parts = ["a", "B-", "@", "@x.y", ".", "..", "+", "+1", " ", "-", "4539148803436467", "4", "37", "256", "12.34.56.78", "(", ")", "é", "\n", "://", "_%"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    got = {row.doc_id: row for row in personal_data.personal_data(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want, row = base_spans(text or ""), got[i]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(row.spans.split(",")) | {""}


ADDED = [
    ("see ftp://me:pw@host.example/x", "login:4:28,email:13:28"),
    ("see ftp://host.example/a@b", ""),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "iban:6:33"),
    ("IBAN NUMBER iban GB82WEST12345698765432", "iban:17:39"),
    ("IBAN DE88 3704 0044 0532 0130 00", ""),
    ("Konto: 12-345 678, account 12345", "account:7:17"),
    ("accounts of 123456", ""),
]


@pytest.mark.parametrize(("text", "spans"), ADDED)
def test_added_spans(spark, documents, text, spans):
    assert personal_data.personal_data(documents([(1, text)])).first().spans == spans


def test_personal_data_of_odd_rows(spark, documents):
    rows = [(1, "a@b.cd"), (1, "a@b.cd"), (None, None), (2, ""), (3, "x " * 200_000 + "me@here.org" + "7" * 100_000)]
    df = documents(rows).withColumns({"spans": F.lit("s"), "a.b": F.lit(1), "n_email": F.lit(9)})
    out = personal_data.personal_data(df, redact=True).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in out)[:4] == [(0, ""), (1, "email:0:6"), (1, "email:0:6"), (2, "")]
    assert {r.text for r in out if r.doc_id == 1} == {"[EMAIL]"}
    long = next(r for r in out if r.doc_id == 3)
    assert (long.n_email, long.spans) == (1, f"email:400000:{400_011 + 100_000}")
    assert personal_data.personal_data(df.limit(0)).count() == 0


def test_strassen_equals_the_plain_product():
    r = np.random.default_rng(3)
    for shape in ((1, 1, 1), (33, 64, 51), (100, 27, 99), (130, 128, 257)):
        a, b = r.integers(-(2**29), 2**29, shape[:2]), r.integers(-(2**29), 2**29, shape[1:])
        assert (hard_negatives.strassen(a, b) == np.array(a.astype(object) @ b.astype(object), dtype=np.int64)).all()


def brute_negatives(rows, positives=5, negatives=5, every=100):
    d = max((len(v) for *_, v in rows), default=0)
    null_last = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, la, va in rows:
        if a is None or a % every or len(va) != d:
            continue
        scored = [(i, lb, sum(x * y for x, y in zip(va, vb, strict=True))) for i, lb, vb in rows if len(vb) == d]
        near = sorted((null_last(s, i), i, s) for i, lb, s in scored if lb == la and i != a)[:positives]
        for _, p, ps in near:
            fits = sorted((null_last(s, i), i, s) for i, lb, s in scored if lb != la and 80 * ps <= 100 * s <= 100 * ps)
            out += [(a, p, k, i, ps, s) for k, (_, i, s) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("strip", [40, 8192])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(hard_negatives, "STRIP", strip)
    monkeypatch.setattr(hard_negatives, "BAND", 3)
    monkeypatch.setattr(hard_negatives, "TILE", 50)
    r = np.random.default_rng(1)
    # Few different entries, so that scores tie; one vector is common.
    raw = [(i, (r.integers(0, 3, 7) / 256 if i % 3 else np.ones(7) / 256).tolist(), int(r.integers(0, 4))) for i in range(700)]
    odd = [(None, raw[1][1], 1), (701, None, 1), (702, [1.0] * 7, None), (703, [None] + [1.0] * 6, 1), (704, [float("nan")] + [1.0] * 6, 1), (705, [1.0], 1)]
    odd += [raw[100], raw[200], (300, [0.5] * 7, 1)]
    rows = {(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, tuple(int(np.floor(256 * x)) for x in v)) for i, v, l in raw + odd if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 7}
    df = spark.createDataFrame(raw + odd, EMBEDDINGS).repartition(4).withColumns({"key": F.lit(1), "score": F.lit(2), "a.b": F.lit(3)})
    got = hard_negatives.hard_negatives(df).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_negatives(rows)
    for none in (df.limit(0), df.where("vec_id % 100 <> 0"), df.where("vec_id = 100")):
        assert hard_negatives.hard_negatives(none).count() == 0


@pytest.mark.parametrize("words", [2, 12, 300])
def test_nearest_examples_equal_brute_force(words):
    r = np.random.default_rng(words)

    def unit(n):
        v = {int(t): float(w) for t, w in zip(r.choice(words, min(n, words), replace=False), r.random(n) + 0.1, strict=False)}
        size = sum(w * w for w in v.values()) ** 0.5
        return {t: w / size for t, w in v.items()}

    vectors = [unit(int(n)) for n in r.integers(1, 6, 900)]
    vectors += [vectors[i] for i in r.integers(0, 900, 300)]
    ids = [int(i) for i in r.permutation(5000)[: len(vectors)]]
    index = toxicity.BlockMaxIndex(vectors, [i % 2 for i in ids], ids)
    by_id = dict(zip(ids, vectors, strict=True))
    queries = [*(unit(4) for _ in range(40)), {}, {words + 5: 1.0}, *vectors[:40]]
    skip = [None] * 42 + ids[:40]
    for query, own, (s, at) in zip(queries, skip, index.nearest(queries, 25, skip), strict=True):
        cosine = [round(sum(w * by_id[i].get(t, 0.0) for t, w in query.items()), 9) for i in index.ids.tolist()]
        want = sorted((-c, place) for place, c in enumerate(cosine) if c > 0 and index.ids[place] != own)[:25]
        assert s.tolist() == pytest.approx([-c for c, _ in want], abs=2e-9)
        assert at.tolist() == [b for _, b in want]
    assert len(toxicity.BlockMaxIndex([], [], []).nearest([{0: 1.0}], 3, [None])[0][0]) == 0
