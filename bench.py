"""Times the headline queries and the published synthetic CSV workload; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

import tablecensus as tc  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2

HEADLINE = (
    "column_completeness_orders",
    "column_completeness_lineitem",
    "completeness_patterns_orders_all",
    "pattern_preview_orders",
    "formal_terms_orders",
    "formal_terms_documents",
    "structural_formats_orders",
    "top_terms_part",
    "group_data_orders",
    "key_uniqueness_lineitem",
    "contract_orders",
    "transform_split_orders",
    "transform_regex_pages",
    "transform_stats_orders",
    "rows_by_pattern",
    "row_filters_documents",
    "rows_page_orders",
    "rows_page_deep_lineitem",
    "column_profile_orders",
    "numeric_summary_orders",
    "normalization_suggestions_part",
    "key_reference_orders_customer",
)
# (rows, patterns) of the published benchmark: 24 columns, 21 analysed.
SYNTHETIC = ((1_000_000, 16), (2_000_000, 16), (1_000_000, 100_000), (2_000_000, 100_000))
COLUMNS, ANALYSED = 24, 21


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tablecensus-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_time(action) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def synthetic_csv(spark: SparkSession, rows: int, patterns: int) -> str:
    """Write the published workload as one CSV file, once per machine."""
    path = Path(tempfile.gettempdir()) / f"tablecensus-bench-{rows}-{patterns}"
    if not (path / "_SUCCESS").exists():
        pattern = F.col("id") % patterns
        text = F.concat(F.lit("value-"), (F.col("id") % 100).cast("string"))
        cells = [
            F.when(F.lit(i >= ANALYSED) | (pattern.bitwiseAND(F.lit(1 << i)) != 0), text).alias(f"column_{i}")
            for i in range(COLUMNS)
        ]
        spark.range(0, rows, 1, 1).select(*cells).write.mode("overwrite").csv(str(path), header=True, emptyValue="")
    return str(path)


def synthetic_workload(spark: SparkSession, path: str, rows: int, patterns: int) -> None:
    """Validate and read the file, then column completeness and patterns, and check the counts."""
    source = tc.read_csv(spark, path)
    columns = source.names[:ANALYSED]
    counts = tc.pattern_counts(source, columns, allow_wide=True).persist()
    completeness = tc.completeness_from_counts(counts, source, columns, allow_wide=True).collect()
    run(tc.patterns_from_counts(counts, source, columns, allow_wide=True))
    assert counts.count() == patterns and completeness[0]["input_rows"] == rows
    for i, row in enumerate(completeness):
        whole, rest = divmod(rows, patterns)
        expected = sum(whole + (p < rest) for p in range(patterns) if i >= ANALYSED or p >> i & 1)
        assert row["present_count"] == expected
    counts.unpersist()


def main() -> None:
    spark = session()
    queries = entry_module().queries()
    run(queries["completeness_patterns_orders"](spark, SF_DIR))
    seconds = {name: best_time(lambda: run(queries[name](spark, SF_DIR))) for name in HEADLINE}
    for rows, patterns in SYNTHETIC:
        path = synthetic_csv(spark, rows, patterns)
        name = f"synthetic_csv_{rows // 1_000_000}m_{patterns}_patterns"
        seconds[name] = best_time(lambda: synthetic_workload(spark, path, rows, patterns))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
