"""Operators against brute force, the tokenizer library and held-out labels; odd rows for all of them."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecensus.llm import decontamination, line_dedup, mixing, near_dedup, quality_model, quality_rules, substring_dedup, tokens, toxicity, url_filters


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words))


def test_substrings_equal_brute_force(spark, documents):
    shared, rows = prose(1, 30), []
    for i in range(12):
        text = f"{prose(i + 10, 20)}{shared if i % 3 == 0 else ''}\n{prose(i + 10, 12)}{shared[20:90] if i % 4 == 0 else 'é' * 60}"
        rows.append((i, text))
    rows += [(20, rows[3][1]), (21, None), (22, ""), (23, "short"), (None, rows[4][1]), (3, rows[3][1])]
    seen = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], (True, 1)), order(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_dedup.substring_dedup(documents(rows)).drop("kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_substrings_of_texts_under_one_id_or_none(spark, documents, doc_id):
    # 600 texts of one crc32 modulo 2^16 and of unequal lengths; each second one holds a string of document 1.
    passage, rows = prose(3, 30), []
    want = [(1, 0, passage)]
    crc = lambda t: zlib.crc32(t.encode()) % 65536
    endings = {crc(e): e for e in (f"{i:08d}" for i in range(1_000_000))}
    for i in range(600):
        own, tail = f"{i}" + "é" * (i % 50) + "\n", passage[: 60 + i % 40] if i % 2 else ""
        # crc32 is linear: the ending that moves it to 99.
        end = endings[crc(own + tail + "0" * 8) ^ crc("0" * 8) ^ 99]
        assert crc(own + tail + end) == 99
        rows.append((doc_id, own + tail + end))
        want.append((doc_id, len(tail), own + end))
    got = substring_dedup.substring_dedup(documents([(1, passage), *rows]), with_text=True).collect()
    assert sorted(((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in got), key=repr) == sorted(want, key=repr)


def sent_rows(docs, kind):
    return [(r.bucket, len(r.data) // kind.itemsize) for r in docs.where("not settled").collect()]


def test_blocks_are_spread_evenly_over_the_buckets(spark, documents):
    docs = documents([(i, prose(i, 400)) for i in range(100)]).selectExpr("doc_id _id", "0L _v", "0L _w", "text _t")
    rows = sent_rows(substring_dedup.anchors(docs, 50), substring_dedup.ANCHOR)
    by_bucket = np.bincount([b for b, _ in rows], [n for _, n in rows], substring_dedup.buckets_of(docs))
    assert by_bucket.sum() > 5000 and by_bucket.max() < 6 * by_bucket.mean()


def test_a_name_of_many_documents_is_sent_once_for_a_part_of_them(spark, documents):
    shared = prose(1, 60)
    docs = documents([(i, shared) for i in range(300)]).coalesce(1).selectExpr("doc_id _id", "0L _v", "0L _w", "text _t")
    once = sent_rows(substring_dedup.anchors(docs.where("_id = 0"), 50), substring_dedup.ANCHOR)
    assert sum(n for _, n in sent_rows(substring_dedup.anchors(docs, 50), substring_dedup.ANCHOR)) == sum(n for _, n in once)


def test_large_buckets_give_the_same_rows_as_small_ones(spark, documents, monkeypatch):
    # A hot passage in unlike and in equal contexts, under ids that repeat and without any.
    hot, same = "x" * 20 + prose(2, 12), prose(3, 60)
    rows = [(None if i % 7 == 0 else i // 2, f"{prose(i, 30)}{hot}{prose(i + 1000, 20)}{same if i % 3 == 0 else ''}") for i in range(300)]
    run = lambda: sorted(map(tuple, substring_dedup.substring_dedup(documents(rows)).drop("kept").collect()), key=repr)
    want = run()
    assert sum(r[2] for r in want) > 300 * len(hot) // 2
    monkeypatch.setattr(substring_dedup, "BUCKETS", 2)
    monkeypatch.setattr(substring_dedup, "MOST", 40)
    assert run() == want


def test_token_counts_equal_the_library(spark, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(5)
    texts = [None, "", "It's ALL aaaa aaa", "<|endoftext|>x<|startoftext|>", "ΑΣ Σ İ ǅ", "á​b", chr(0x1C89) + "x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000)])) for _ in range(40)) for _ in range(300)]
    with open(path) as file:
        rows = tokens.token_counts(documents(list(enumerate(texts))), file.read()).collect()
    library = tokenizers.Tokenizer.from_file(path)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids), repr(text)
        assert row.n_bytes == len(text.encode())


def test_near_copies_meet_and_others_do_not(spark, documents):
    base, rows = prose(1, 200).split(), []
    for i in range(6):
        words = list(base)
        words[20 * i] = f"changed{i}"
        rows.append((i, " ".join(words)))
    half = " ".join(base[:100]) + " " + prose(9, 100)
    rows += [(10, half), (11, prose(3, 200)), (12, rows[0][1]), (13, None), (14, ""), (15, "two words"), (None, rows[1][1]), (11, prose(3, 200))]
    out = near_dedup.near_duplicates(documents(rows)).collect()
    classes = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(rows)
    assert [classes[i] for i in (*range(6), 12, None)] == [0] * 8
    assert (classes[10], classes[11], classes[13], classes[14], classes[15]) == (10, 11, 13, 13, 15)
    kept = sorted(r.doc_id for r in near_dedup.one_of_each(documents(rows)).collect())
    assert kept == [0, 10, 11, 13, 15]


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    return row[-1]


def test_banded_alignment_equals_the_whole_table():
    r = random.Random(11)
    for _ in range(1500):
        words = r.choice([2, 3, 10, 1000])
        a = [r.randrange(words) for _ in range(r.randrange(40))]
        b = list(a) if r.random() < 0.8 else [r.randrange(words) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(10)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(words)] * r.randrange(2)
        want, x, y = word_edits(a, b), np.array(a, np.uint64), np.array(b, np.uint64)
        for most in (0, 1, 2, 5, 9, 15, 50):
            assert near_dedup.edits_within(x, y, most) == (want if want <= most else None)
        long = max(len(a), len(b))
        with np.errstate(over="ignore"):
            for least in (0.5, 0.8, 0.9):
                reached = long and want <= int(long * (1 - least) + 1e-9)
                assert near_dedup.edit_similarity(x, y, least) == (1 - want / long if reached else 0.0)


def classes_of(links, n):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("copies", [300, 1000])
def test_near_links_equal_brute_force_around_a_hub(spark, documents, copies):
    # Each copy has another run of 45 words than the base: 0.85 like the base, mostly below 0.8 like each other.
    base, r, middle = prose(4, 304).split(), random.Random(6), copies // 2
    texts = []
    for i in range(copies + 1):
        words = list(base)
        if i != middle:
            begin = r.randrange(260)
            words[begin : begin + 45] = [f"edit{i}x{k}" for k in range(len(words[begin : begin + 45]))]
        texts.append(" ".join(words))
    with np.errstate(over="ignore"):
        keys = np.array([near_dedup.order_minhash(near_dedup.labelled_kmers(t), 40, 4) for t in texts])
        words = [near_dedup.word_hashes(t) for t in texts]
        like = lambda i, j: near_dedup.edit_similarity(words[i], words[j], 0.8) >= 0.8
        linked = [(i, j) for i in range(copies + 1) for j in np.flatnonzero((keys[:i] == keys[i]).any(axis=1)).tolist() if like(i, j)]
    root = classes_of(linked, copies + 1)
    assert root.count(root[middle]) > copies * 0.9
    out = near_dedup.near_duplicates(documents(list(enumerate(texts)))).collect()
    assert {x.doc_id: x.class_id for x in out} == dict(enumerate(root))


def test_texts_that_meet_without_a_link_are_never_rows_by_pairs(spark, documents, monkeypatch):
    # 200 texts share a passage of 600 words and have 200 words of their own: 0.75 like each other.
    passage = prose(8, 600)
    texts = [passage + " " + " ".join(f"own{i}x{k}" for k in range(200)) for i in range(200)]
    made, tied, stored, components = {}, [], near_dedup.stored, near_dedup.components

    def counted(df, name):
        out = stored(df, name)
        made[name] = out.count()
        return out

    def watched(links, name):
        tied.append(links.count())
        return components(links, name)

    monkeypatch.setattr(near_dedup, "stored", counted)
    monkeypatch.setattr(near_dedup, "components", watched)
    out = near_dedup.near_duplicates(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id: r.class_id for r in out} == {i: i for i in range(200)}
    assert 0 < made["near-across"] <= made["near-open"] < 200 * 199 / 2
    # What the first round has tied together is not tied again.
    base = passage.split()
    copies = [" ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) for i in range(0, 600, 10)]
    tied.clear()
    out = near_dedup.near_duplicates(documents(list(enumerate([passage, *copies])))).collect()
    assert {r.class_id for r in out} == {0}
    assert tied[0] >= 60 and tied[1] == 0


def test_near_copies_without_ids_and_under_one_id(spark, documents):
    base = prose(1, 200).split()
    near = lambda i: " ".join([*base[:i], f"changed{i}", *base[i + 1 :]])
    other = prose(2, 100)
    rows = [(None, near(3)), (None, near(90)), (None, near(90)), (None, other), (None, other + " end")]
    classes = near_dedup.near_duplicates(documents(rows)).collect()
    assert [r.class_id for r in classes] == [None] * 5
    assert all(r.n_links for r in classes)
    assert near_dedup.one_of_each(documents(rows)).count() == 2
    # Document 7 has two texts: it ties copies of both together; rows without an id join their class.
    rows += [(7, near(50)), (7, other + " close"), (9, near(60)), (8, other)]
    classes = near_dedup.near_duplicates(documents(rows)).collect()
    assert {r.class_id for r in classes} == {7} and len(classes) == 9
    assert [r.doc_id for r in near_dedup.one_of_each(documents(rows)).collect()] == [7]


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_near_copies_are_found_among_all_pairs(spark, sf_dir, least):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    with np.errstate(over="ignore"):
        words = {r.doc_id: near_dedup.word_hashes(r.text) for r in texts}
        bags = {i: np.sort(near_dedup.labelled(w)) for i, w in words.items()}
        ids, pairs = sorted((i for i in words if len(words[i])), key=lambda i: len(words[i])), []
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                long = len(words[j])
                if len(words[i]) < least * long:
                    break
                if len(np.intersect1d(bags[i], bags[j], assume_unique=True)) >= least * long - 1e-9:
                    if near_dedup.edit_similarity(words[i], words[j], least) >= least:
                        pairs.append((i, j))
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, least=least).collect()}
    text = {r.doc_id: r.text for r in texts}
    unlike = [(i, j) for i, j in pairs if text[i] != text[j]]
    met = sum(found[i] == found[j] for i, j in unlike)
    print(f"{met} of {len(unlike)} pairs of different texts at {least}")
    assert unlike and met >= 0.9 * len(unlike)
    assert all(found[i] == found[j] for i, j in pairs if text[i] == text[j])



def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        fresh = [i]
        for j, d in enumerate(text, 1):
            fresh.append(min(row[j - 1] + (c != d), row[j] + 1, fresh[j - 1] + 1))
        row = fresh
    return min(row)


def test_benchmark_passages_equal_brute_force(spark, documents):
    items = [(i, prose(100 + i, 15)) for i in range(5)] + [(9, "tiny"), (None, "x"), (8, None)]
    r, rows = random.Random(2), []
    for i in range(40):
        item = list(items[i % 5][1])
        for _ in range(i // 4):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice([[], ["z"], [item[at], "y"]])
        rows.append((i, f"{prose(i, 20)}\n {''.join(item).upper() if i % 2 else ''.join(item)}  {prose(i + 50, 5)}"))
    rows += [(50, None), (51, ""), (52, prose(77, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.benchmark_passages(documents(rows), bench).collect()}
    for i, text in rows:
        plain = " ".join((text or "").lower().split())
        assert got[i] == [k for k, t in items[:5] if edits(t, plain) <= len(t) // 10], i


def test_models_hold_out_and_learn(spark, driver, sf_dir):
    for name, label in (("op7_quality_model", "quality"), ("op8_toxicity", "toxic")):
        out = driver.queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01"))
        labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
        hits = out.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("hit"))
        assert hits.agg(F.avg("hit")).first()[0] > 0.9
        assert out.where("score < 0 or score > 1 or score is null").count() == 0


ODD = {
    "quality rules": (quality_rules.quality_rules, quality_rules.keep_good),
    "mixing": (mixing.mix, None),
    "line dedup": (line_dedup.line_dedup, line_dedup.without_repeated_lines),
    "decontamination": (decontamination.benchmark_passages, decontamination.without_benchmark),
    "quality model": (quality_model.quality_scores, None),
    "toxicity": (toxicity.toxicity, None),
    "substring dedup": (substring_dedup.substring_dedup, None),
    "near dedup": (near_dedup.near_duplicates, near_dedup.one_of_each),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows_and_empty_tables(spark, documents, name):
    rows = [(1, "a b\nc", "en", None), (1, "a b\nc", "en", None), (None, None, None, None), (2, "", None, "s"), (3, "word " * 30_000, "xx", "s")]
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = {"decontamination": (bench,), "quality model": (labels,), "toxicity": (labels,)}.get(name, ())
    odd = documents(rows).withColumns({"_row": F.lit(1), "size": F.lit(2), "rank": F.lit(3), "a.b": F.lit(4), "_text": F.lit("t")})
    operator, stage = ODD[name]
    for docs, n in ((odd, 5), (odd.limit(0), 0)):
        assert operator(docs, *more).count() == n
        if stage:
            out = stage(docs, *more)
            assert out.columns == docs.columns
            assert out.count() <= n


def test_urls_without_a_host(spark):
    pages = spark.createDataFrame([(1, None, ""), (2, "no host", ""), (2, "HTTP://A.Example.ORG/es/x?y", "")], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    out = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filters.url_filters(pages, rules).collect()}
    assert out == {(1, ""): ("", None, "allow"), (2, ""): ("", None, "allow"), (2, "a.example.org"): ("/es/x", "example.org/es/", "block")}


def test_pipeline_keeps_columns_and_drops_what_its_stages_name(spark, driver, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = driver.queries()["pipeline"](spark, sf_dir)
    assert out.columns == [*docs.columns, "copies"]
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert kept and kept <= good


def test_any_number_of_rules_of_other_lengths(spark):
    rules = [(f"h{i % 7}.net", "/" + "a" * i, "block") for i in range(400)]
    rules += [("net", "/", "allow"), ("net", "", "block"), ("a.b.c.d.e.f.g", "", "block"), (None, "/", "block"), ("net", None, "block")]
    urls = [f"http://{'x.' * (i % 3)}h{i % 9}.net/{'a' * (i * 5 % 450)}{'b' if i % 4 else ''}" for i in range(300)]
    urls += ["http://net", "http://a.b.c.d.e.f.g/x", "http://z.a.b.c.d.e.f.g", "http://b.c.d.e.f.g", "http://", None, "no host"]
    pages = list(enumerate(urls)) + [(0, urls[0])] * 3 + [(None, urls[7]), (None, urls[7]), (0, urls[1])]

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, _, path = rest.partition("/")
        path = "/" + path if "/" in rest else ""
        fits = [(len(h + p), v, h + p) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fits)[2], max(fits)[1]) if fits else (None, "allow")))

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.url_filters(spark.createDataFrame(pages, "page_id long, url string").repartition(4), table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *judged(u)) for i, u in pages), key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    table = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filters.url_filters(pages, table).collect()] == [(1, "a.net", "/x", None, "allow")] * 2
    assert url_filters.url_filters(pages.limit(0), table).collect() == []


def test_mix_keeps_a_column_named_copies(spark, documents):
    docs = documents([(1, "a b", "en", "s"), (2, "c d e", "en", "t"), (3, None, "en", None)])
    docs = docs.withColumn("Copies", F.lit("own"))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copies_2"]
    assert {r["Copies"] for r in out.select("Copies", "copies_2").collect()} == {"own"}


def test_the_quality_verdict_is_compiled(spark, documents):
    # Code of more than 64 KB is not: the driver tries at great cost, and the rows are interpreted.
    counted = near_dedup.stored(quality_rules.with_counts(documents([(1, prose(1, 300))])), "quality")
    refs = near_dedup.stored(quality_rules.references(counted), "references")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = quality_rules.with_verdict(counted, refs).select("doc_id", "_v.kept")._jdf.queryExecution()
        code = plan.debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and min(sizes) > 0
