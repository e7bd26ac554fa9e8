"""URL filters: host suffixes and path prefixes joined to rules on a short hash, then confirmed.

Host suffixes meet the hosts of the rules first. Of a path only those prefixes are expanded whose
lengths the rules of a host found have, so rules may have any number of path lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the registered query, (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
MAX_BROADCAST_RULES = 100_000


def host_and_path(url):
    """Columns for host (A-Z lowered) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def digest(host: Column, path: Column | None = None) -> Column:
    return F.sha2(host if path is None else F.concat(host, F.lit("\n"), path), 256)


def confirmed(expressions: DataFrame, table: DataFrame) -> DataFrame:
    """``expressions`` joined to the rows of ``table`` with their ``_digest``: by 8 digits, then by all."""
    short = table.withColumn("_short", F.substring("_digest", 1, 8)).withColumnRenamed("_digest", "_full")
    if table.count() <= MAX_BROADCAST_RULES:
        short = F.broadcast(short)
    return expressions.withColumn("_short", F.substring("_digest", 1, 8)).join(short, "_short").where("_full = _digest").drop("_short", "_full", "_digest")


def url_filters(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: host, path, the longest fitting rule and its verdict.

    ``rules`` has ``host``, ``path`` and ``verdict``; rows with a null host or path never fit, of
    equal rules a block wins. A url that is null or has no ``://`` has empty parts and gets the
    default, as does every url without a fitting rule. Repeated pages are judged each for itself;
    further columns are ignored; empty tables give empty results.
    """
    wanted = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    wanted = wanted.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = wanted.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    most = hosts.agg(F.max(F.size(F.split("_host", r"\."))).alias("n")).first()["n"] or 0
    hosts = hosts.withColumn("_digest", digest(F.col("_host")))
    wanted = wanted.select(F.concat("host", "path").alias("_rule"), "verdict", digest(F.col("host"), F.col("path")).alias("_digest"))
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = parts.withColumn("_parts", F.split("host", r"\."))
    # The last labels of the host, as many as some rule's host has at most.
    count = F.least(F.size("_parts"), F.lit(most))
    suffixes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice("_parts", F.size("_parts") - n + 1, n), ".")))
    expanded = labels.select("page_id", "host", "path", F.explode(suffixes).alias("_suffix")).withColumn("_digest", digest(F.col("_suffix")))
    met = confirmed(expanded, hosts)
    lengths = F.filter("_lengths", lambda n: n <= F.length("path"))
    tried = met.select("page_id", "host", "path", "_host", F.explode(lengths).alias("_n"))
    tried = tried.select("page_id", "host", "path", digest(F.col("_host"), F.expr("substring(path, 1, _n)")).alias("_digest"))
    best = F.struct(F.length("_rule").alias("chars"), "verdict", "_rule").alias("_best")
    hits = confirmed(tried, wanted).select("page_id", "host", "path", F.lit(0).alias("_one"), best)
    # Equal pages are one row here, with their number. No row needs a name, so that a repeated task
    # or another order of the rows changes nothing.
    rows = parts.withColumn("_one", F.lit(1)).unionByName(hits, allowMissingColumns=True)
    judged = rows.groupBy("page_id", "host", "path").agg(F.sum("_one").alias("_n"), F.max("_best").alias("_best"))
    judged = judged.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return judged.select("page_id", "host", "path", F.col("_best._rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
