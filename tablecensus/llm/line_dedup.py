"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Suffixes are ranked by their first line, then by twice as many lines in each step, until runs of
``min_lines`` lines have ranks. Only suffixes whose prefix occurs more than once go on, so the work
shrinks with every step. Suffixes of equal rank are an interval of the suffix array whose longest
common prefix is at least the run length; all of its members but the first are later copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, let, stored


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with a word: document key (``_doc, _th``), place in the text, place among them, line ID."""
    key = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(
        F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("x"))),
        lambda s: F.length(F.btrim(s["x"], F.lit(" \t\n\x0b\f\r"))) > 0,
    )
    ids = F.transform(
        lines,
        lambda s: F.struct(
            s["at"].alias("at"), F.xxhash64(s["x"]).alias("h1"), F.xxhash64(F.lit(1), s["x"]).alias("h2"),
            F.size(F.array_remove(F.split(s["x"], SPACE), "")).alias("words"),
        ),
    )
    return key.select("_doc", F.xxhash64("t").alias("_th"), F.posexplode(ids).alias("i", "l")).select("_doc", "_th", "i", "l.*")


def ranked(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys with ``n`` (occurrences), ``first`` (smallest place) and ``rank``.

    The rank is the number of suffixes with a smaller key: counts are combined before the shuffle,
    distinct keys are range-partitioned, and partition totals are added up.
    """
    place = F.struct(F.col("_doc").isNull().alias("z"), "_doc", "_th", "i")
    counted = keys.groupBy(*columns).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    parts = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stored(counted.repartitionByRange(int(parts), *columns).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(F.sum("n").alias("t"))
    offsets = totals.select("_part", (F.sum("t").over(Window.orderBy("_part")) - F.col("t")).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("_part").orderBy(*columns)) - F.col("n")
    # One row per partition: bounded by the number of shuffle partitions.
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select(*columns, "n", "first", (F.col("offset") + F.col("_inside")).alias("rank"))


def repeated_runs(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """Places (``_doc, _th, i``) of the lines to delete."""
    place = F.struct(F.col("_doc").isNull().alias("z"), "_doc", "_th", "i")
    later = (place != F.col("first")).alias("later")
    lines = stored(line_table(docs), "line-ids")
    first = stored(ranked(lines, ["h1", "h2"], "line-keys"), "line-ranks")
    ranks = lines.join(first, ["h1", "h2"]).select("_doc", "_th", "i", "words", "rank", later)
    # Rows with equal doc_id and text are one document.
    ranks = stored(ranks.distinct(), "line-suffixes-1")
    # A single long line is a run of its own.
    gone = ranks.where(F.col("later") & (F.col("words") >= min_words)).select("_doc", "_th", "i")
    have = 1
    while have < min_lines:
        step = min(have, min_lines - have)
        ahead = ranks.select(F.col("_doc").alias("d"), F.col("_th").alias("t"), (F.col("i") - step).alias("j"), F.col("rank").alias("rank2"))
        same = F.col("_doc").eqNullSafe(F.col("d")) & (F.col("_th") == F.col("t")) & (F.col("i") == F.col("j"))
        pairs = ranks.join(ahead, same).select("_doc", "_th", "i", F.col("rank").alias("rank1"), "rank2")
        pairs = stored(pairs, f"line-pairs-{have}")
        fresh = stored(ranked(pairs, ["rank1", "rank2"], f"line-keys-{have}"), f"line-ranks-{have}")
        have += step
        ranks = pairs.join(fresh, ["rank1", "rank2"]).select("_doc", "_th", "i", "rank", later)
        ranks = stored(ranks, f"line-suffixes-{have}")
    runs = ranks.where("later").select("_doc", "_th", F.explode(F.sequence(F.col("i"), F.col("i") + min_lines - 1)).alias("i"))
    return gone.union(runs).distinct()


def marked(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """``_row`` (all columns), ``_lines`` of its text, and ``_gone``, the numbers of deleted lines."""
    gone = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words)
    marks = gone.groupBy("_doc", "_th").agg(F.array_sort(F.collect_set("i")).alias("_gone"))
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("_row"))
    packed = packed.withColumns({"_id": F.col("_row.doc_id"), "_key": F.xxhash64(text)})
    # Marks of a document are one row: whole texts move once, whatever lines they share.
    joined = packed.join(marks, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_th")), "left")
    return joined.select("_row", F.split(text, "\n").alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))


def kept_text():
    """The lines that are not deleted, joined again; ``_gone`` numbers the lines with a word."""
    numbers = F.transform("_lines", lambda x, i: F.when(F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0, i))
    gone = let(F.array_compact(numbers), lambda n: F.transform("_gone", lambda i: n[i]))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    rebuilt = F.array_join(let(F.col("_lines"), lambda a: F.transform(left, lambda i: a[i])), "\n")
    return F.when(F.size("_gone") > 0, rebuilt).otherwise(F.col("_row.text"))


def without_repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 20) -> DataFrame:
    """``docs`` with repeated line runs deleted from ``text``, all columns kept.

    A run is deleted where it occurs again: ``min_lines`` or more lines in a row, or a single line of
    ``min_words`` or more words, that also start earlier in order of doc_id (null last) and place.
    Runs lie inside one document; lines without a word are skipped by runs and never deleted. Rows
    with equal doc_id and text are one document and are treated alike; null and empty texts stay as
    they are, an empty table gives an empty result. A text whose lines are all deleted becomes empty.
    """
    done = marked(docs, min_lines, min_words).withColumn("_text", kept_text())
    return done.select(*[F.col("_text" if c == "text" else f"_row.{quoted(c)}").alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, min_lines: int = 3, min_words: int = 20) -> DataFrame:
    """One row per document: doc_id, text (without repeated runs), n_lines, n_removed, n_runs.

    ``n_lines`` are lines with a word, ``n_runs`` maximal runs of deleted lines. Cases as in
    ``without_repeated_lines``.
    """
    done = marked(docs.select("doc_id", "text"), min_lines, min_words)
    words = F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    heads = F.filter("_gone", lambda x, j: (j == 0) | (F.get("_gone", j - 1) != x - 1))
    return done.select(
        F.col("_row.doc_id").alias("doc_id"), kept_text().alias("text"), F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"), F.size(heads).cast("long").alias("n_runs"),
    )


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
