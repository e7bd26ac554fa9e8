"""Quality rules: counts per document, and Jensen-Shannon distances to references of its language.

Everything is built-in functions over arrays inside the row; the only shuffle carries one row per
language and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, let, stored

# The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
# Frequent words by language, the bins of the word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was"],
    "de": ["der", "die", "und", "das", "ist", "in", "den", "zu", "von", "mit", "ein", "nicht"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "est", "que", "dans", "pour"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "un", "se", "del", "las", "una"],
}
#: Bins of the character histogram, in the order in which each takes its characters out of the text.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("mark", r"[.,;:!?'\"()-]+"), ("symbol", r"[\x21-\x7E]+"))
MAX_BROADCAST_ROWS = 4096


def with_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the counts and histograms as fields of ``_q``; ``docs`` keeps its columns."""
    bins = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn("_q", F.struct(body.alias("body"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")))
    words = F.array_remove(F.split(F.col("_q.body"), SPACE), "")
    step = step.withColumn("_qw", words)
    # Each class is what its replacement removes; only the first replacement sees the whole text.
    step = step.withColumn("_q0", F.array_join("_qw", ""))
    for i, (_, pattern) in enumerate(CLASSES):
        step = step.withColumn(f"_q{i + 1}", F.regexp_replace(F.col(f"_q{i}"), pattern, ""))
    sizes = [F.length(f"_q{i}").cast("long") for i in range(len(CLASSES) + 1)]
    classes = F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])
    lines = F.filter(F.split(F.col("_q.body"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    listed = [w for v in COMMON_WORDS.values() for w in v]
    kept = F.filter(F.transform("_qw", lambda w: F.lower(w)), lambda w: w.isin(*sorted(set(listed))))
    own = F.coalesce(bins[F.col("_q.lang")], bins[F.lit("en")])
    common = let(kept, lambda k: F.transform(own, lambda c: F.size(F.filter(k, lambda w: w == c)).cast("long")))
    counts = F.struct(
        F.col("_q.lang").alias("lang"),
        F.size("_qw").cast("long").alias("n_words"),
        sizes[0].alias("word_chars"),
        # Symbols are never letters or digits: they are all left after those are gone.
        (F.length("_q3") - F.length(F.regexp_replace("_q3", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_qw")).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        common.alias("common"),
    )
    step = step.withColumn("_c", counts)
    return step.select(*[c for c in docs.columns], F.col("_c").alias("_q"))


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more."""
    windows = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    )

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda s, j: F.get(s, j)["h"]
        twice = lambda s: F.filter(F.transform(s, lambda x, j: F.when((at(s, j - 1) == x["h"]) | (at(s, j + 1) == x["h"]), x["i"])), lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(let(pairs, twice), lambda p: F.array(p, p + 1, p + 2)))))

    counted = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < 4, 0).otherwise(counted)


def base_failed() -> Column:
    return (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))


def references(counted: DataFrame) -> DataFrame:
    """One row per language: summed histograms of the documents that pass the base rules."""
    classes = [F.sum(F.col("_q.classes")[i]) for i in range(len(CLASSES) + 1)]
    common = [F.sum(F.get(F.col("_q.common"), F.lit(i))) for i in range(12)]
    return (
        counted.where(~base_failed())
        .groupBy(F.col("_q.lang").alias("_r_lang"))
        .agg(F.sum("_q.n_words").alias("_r_words"), F.array(*classes).alias("_r_classes"), F.array(*common).alias("_r_common"))
    )


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)


def distance(counts: Column, size: Column, ref: Column, ref_size: Column) -> Column:
    """Jensen-Shannon distance (square root, logarithm to base 2) of two histograms (arrays).

    The bins stay in arrays: an expression for each of them made code that was too long to be compiled.
    """

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    pairs = F.zip_with(counts, ref, lambda x, y: F.struct((x / size).alias("p"), (y / ref_size).alias("q")))
    terms = F.transform(pairs, lambda z: part(z["p"], z["q"]) + part(z["q"], z["p"]))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))


def with_verdict(
    counted: DataFrame,
    refs: DataFrame,
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.27,
    min_words: int = 100,
    min_reference_words: int = 10_000,
) -> DataFrame:
    """Add ``_v`` with both distances (null where a guard applies), ``base_failed`` and ``kept``."""
    if refs.count() <= MAX_BROADCAST_ROWS:
        refs = F.broadcast(refs)
    joined = counted.join(refs, F.col("_q.lang") == F.col("_r_lang"), "left")
    judged = (F.col("_q.n_words") >= min_words) & (F.coalesce(F.col("_r_words"), F.lit(0)) >= min_reference_words)
    classes, ref_classes = F.col("_q.classes"), F.col("_r_classes")
    by_class = F.when(judged, distance(classes, total(classes), ref_classes, total(ref_classes)))
    words, ref_words = F.col("_q.n_words"), F.col("_r_words")
    others = lambda common, all_: F.concat(common, F.array(all_ - total(common)))
    by_word = F.when(judged, distance(others(F.col("_q.common"), words), words, others(F.col("_r_common"), ref_words), ref_words))
    joined = joined.withColumn("_v", F.struct(by_class.alias("class_distance"), by_word.alias("word_distance")))
    far = (F.coalesce("_v.class_distance", F.lit(0.0)) > max_class_distance) | (
        F.coalesce("_v.word_distance", F.lit(0.0)) > max_word_distance
    )
    verdict = F.struct(
        F.col("_v.class_distance"), F.col("_v.word_distance"), base_failed().alias("base_failed"), (~base_failed() & ~far).alias("kept")
    )
    return joined.withColumn("_v", verdict).drop("_r_lang", "_r_words", "_r_classes", "_r_common")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: its counts, both distances, ``base_failed`` and ``kept``.

    Null or empty text: no words, base rules fail. Null or unknown language: its own reference group,
    with the English word bins; groups with little text give no distances. Repeated rows are judged
    each for itself, other columns are ignored, an empty table gives an empty result.
    """
    narrow = stored(with_counts(docs.select("doc_id", "text", "lang")).select("doc_id", "_q"), "quality")
    refs = stored(references(narrow), "quality-references")
    out = with_verdict(narrow, refs, **limits)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(
        "doc_id", *[F.col(f"_q.{f}") for f in fields], "_v.base_failed", "_v.kept", "_v.class_distance", "_v.word_distance"
    )


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept."""
    packed = docs.select(F.struct("*").alias("_row"))
    packed = packed.select("_row", F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang"))
    # Both are written: a filter on the verdict would else repeat the counting in each of its terms.
    counted = stored(with_counts(packed).select("_row", "_q"), "quality-counts")
    refs = stored(references(counted.select("_q")), "quality-references")
    judged = stored(with_verdict(counted, refs, **limits).select("_row", F.col("_v.kept").alias("_keep")), "quality-verdicts")
    return judged.where("_keep").select("_row.*")
