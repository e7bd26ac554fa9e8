"""

The given tables hold no missing cells, so most queries read them through the views below, whose
SQL text Spark and DuckDB share.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tablecensus as tc  # noqa: E402
from tablecensus.functions import text as text_functions  # noqa: E402
from tablecensus.sources.row_ids import with_row_position  # noqa: E402

try:  # the pipeline operators are an optional part
    import corpus_pipeline
    from tablecensus.llm.oracles import ORACLES as LLM_ORACLES
    from tablecensus.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as error:
    # Only the part itself may be absent, not a library that it needs.
    if error.name != "corpus_pipeline" and not str(error.name).startswith("tablecensus.llm"):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    LLM_ORACLES = {**LLM_ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

# Python workers get the helper functions with the job, wherever the driver was started.
cloudpickle.register_pickle_by_value(tc)

SMOKE_DIR = "/root/testdata/sf0.001"

VIEWS = {
    "orders_dirty": """
        select o_orderkey, o_custkey,
          case when o_orderkey % 3 = 0 then '' when o_orderkey % 13 = 0 then 'n/a'
               else o_orderstatus end as status,
          case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then '   '
               when o_orderkey % 11 = 0 then ' N/A ' else o_orderpriority end as priority,
          case when o_orderkey % 17 = 0 then '2023-02-29' when o_orderkey % 19 = 0 then '2024-2-09'
               when o_orderkey % 23 = 0 then null
               else cast(cast(o_orderdate as date) as string) end as order_date,
          case when o_orderkey % 29 = 0 then '1e3' when o_orderkey % 31 = 0 then '1,000'
               when o_orderkey % 37 = 0 then 'NaN' when o_orderkey % 41 = 0 then ''
               else cast(o_orderkey as string) end as qty_text,
          concat('ORD_', cast(o_orderkey as string), '_', o_orderstatus) as code
        from {orders}""",
    "events_text": """
        select event_id,
          case when event_id % 10 = 0 then '' when event_id % 10 = 1 then 'none'
               when event_id % 10 = 2 then concat(' ', event_type) else event_type end as event_type,
          concat(cast(cast(ts as date) as string), ' ', lpad(cast(hour(ts) as string), 2, '0'), ':',
                 lpad(cast(minute(ts) as string), 2, '0'), ':00') as ts_text,
          props
        from {events}""",
    "part_text": """
        select p_partkey, p_brand, p_type,
          case when p_partkey % 4 = 0 then upper(p_name) when p_partkey % 4 = 1 then concat(' ', p_name, ' ')
               else p_name end as p_name,
          case when p_partkey % 9 = 0 then concat('=', p_brand) when p_partkey % 9 = 1 then concat(' +', p_brand)
               else p_brand end as export_text
        from {part}""",
}
VIEW_SOURCE = {"orders_dirty": "orders", "events_text": "events", "part_text": "part"}
ORDERS_MARKERS = {"status": ["n/a"], "priority": ["N/A"]}
EVENTS_MARKERS = {"event_type": ["none"]}
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "status", "priority", "order_date", "qty_text", "code"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = VIEW_SOURCE[name]
    return spark.sql(VIEWS[name], **{source: read(spark, sf_dir, source)})


def orders(spark: SparkSession, sf_dir: str) -> tc.Table:
    return tc.table(view(spark, sf_dir, "orders_dirty"), ORDERS_MARKERS, ["o_orderkey"])


def events(spark: SparkSession, sf_dir: str) -> tc.Table:
    return tc.table(view(spark, sf_dir, "events_text"), EVENTS_MARKERS, ["event_id"])


def part(spark: SparkSession, sf_dir: str) -> tc.Table:
    return tc.table(view(spark, sf_dir, "part_text"), order_by=["p_partkey"])


def plain(spark: SparkSession, sf_dir: str, name: str, *order: str) -> tc.Table:
    return tc.table(read(spark, sf_dir, name), order_by=list(order) or None)


CONTRACT = {
    "version": 1,
    "rules": [
        {"column": "status", "kind": "required"},
        {"column": "status", "kind": "enum", "values": ["F", "O"]},
        {"column": "qty_text", "kind": "type", "value_type": "integer"},
        {"column": "qty_text", "kind": "type", "value_type": "number"},
        {"column": "order_date", "kind": "type", "value_type": "date", "date_format": "YYYY-MM-DD"},
        {"column": "priority", "kind": "required"},
    ],
}
EVENTS_CONTRACT = {
    "version": 1,
    "rules": [
        {"column": "event_type", "kind": "required"},
        {"column": "ts_text", "kind": "type", "value_type": "date", "date_format": "YYYY-MM-DD HH:MM:SS"},
        {"column": "ts_text", "kind": "type", "value_type": "date", "date_format": "YYYY-MM-DD"},
    ],
}


def rule(column: str, target: str | None, kind: str, **config) -> dict:
    mode = "overwrite" if target is None else "new_column"
    return {
        "id": f"{kind}_{target or column}",
        "source_column": column,
        "target_column": target or "",
        "target_mode": mode,
        "transform_type": kind,
        "config": config,
    }


SPLIT_RULES = [
    rule("code", "first", "delimiter_split", position="before"),
    rule("code", "rest", "delimiter_split", position="after"),
    rule("code", "last", "delimiter_split", position="after_last"),
    rule("code", "second", "delimiter_split", position="part_index", part_index=2),
    rule("code", "fourth", "delimiter_split", position="part_index", part_index=4),
    rule("rest", "number", "delimiter_split", position="before_first"),
]
SUBSTRING_RULES = [
    rule("c_name", "head", "substring", mode="first_n", count=4),
    rule("c_name", "cut", "substring", mode="first_n", count=-3),
    rule("c_name", "tail", "substring", mode="last_n", count=5),
    rule("c_name", "middle", "substring", mode="range", start=2, length=6),
    rule("c_name", "near_end", "substring", mode="range", start=-6, length=3),
]
DATE_RULES = [
    rule("ts_text", "day", "date_truncate"),
    rule("ts_text", "clock", "date_truncate", part="time_only"),
    rule("ts_text", "hour_text", "date_truncate", delimiter=":"),
    rule("ts_text", "minute_text", "date_truncate", part="time_only", delimiter=":"),
]
CASE_RULES = [
    rule("p_name", "upper_name", "case_trim", case="upper"),
    rule("p_name", "lower_name", "case_trim", case="lower", trim=False),
    rule("p_name", "title_name", "case_trim", case="title"),
    rule("p_name", None, "case_trim"),
]
# Ends of dates begin with a hyphen, which a spreadsheet reads as a formula.
RAW_RULES = [rule("order_date", "tail", "substring", mode="range", start=4, length=0)]
STATISTICS_RULES = [
    rule("status", "letter", "substring", count=1),
    rule("order_date", "year", "regex_extract", pattern=r"^(\d{4})-\d{2}-"),
    rule("qty_text", "split", "delimiter_split", delimiter=","),
    rule("unknown", "skipped", "case_trim"),
]


def export_path(spark: SparkSession) -> str:
    """A new place that all executors see; a local folder only where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors see.")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/tablecensus-export-{uuid.uuid4().hex}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the rows as CSV, read the files back, and count the patterns of what was read."""
    path = export_path(spark)
    tc.write_rows(orders(spark, sf_dir), path, one_document=False)
    source = tc.read_csv(spark, path, ORDERS_MARKERS)
    return tc.completeness_patterns(source, ["status", "priority", "order_date", "qty_text"])


def csv_read_back(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Columns of the documents with their line breaks, written as raw cells and read back as text."""
    path = export_path(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    tc.write_rows(tc.table(documents), path, one_document=False, inert=False)
    return tc.read_csv(spark, path).to_df()


def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = csv_read_back(spark, sf_dir, ["doc_id", "text", "lang", "source", "n_chars"])
    return cells.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"), "lang", "source", "n_chars")


def csv_single_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = csv_read_back(spark, sf_dir, ["text"])
    return cells.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("input_rows"))


LARGE_INTEGER = "case when o_orderkey % 10 = 0 then '' else concat('3689348814741', lpad(cast(o_orderkey as string), 12, '0')) end"
# The later table: other columns, another order, and other missing cells over the same rows.
LATER_STATUS = "case when o_custkey % 2 = 0 then '' else status end"


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = orders(spark, sf_dir)
    later = whole.to_df(["o_custkey", "status", "qty_text", "code"]).selectExpr("o_custkey", f"{LATER_STATUS} as status", "qty_text", "code")
    reduced = tc.table(later, {"status": ["n/a"]})
    before_settings = tc.snapshot_settings(tc.table(whole.to_df(), {"status": ["n/a"]}))
    compared = tc.compare_snapshots(
        tc.snapshot_of(tc.column_profile(tc.table(whole.to_df(), {"status": ["n/a"]}))),
        tc.snapshot_of(tc.column_profile(reduced)),
        before_settings,
        tc.snapshot_settings(reduced),
    )
    return compared.select(
        "column_name",
        "column_change",
        "input_rows_change",
        "missing_count_before",
        "missing_count_after",
        "distinct_term_count_before",
        "distinct_term_count_after",
        "format_count_before",
        "format_count_after",
        "rows_with_format_change",
    )


def integer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers beyond 64 bits: no figure passes through a double."""
    source = tc.table(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{LARGE_INTEGER} as big"))
    summary = tc.value_summary(source, "big", "integer")
    texts = {"min_value": "min_value", "max_value": "max_value", "q0.25": "q1", "q0.5": "q2", "q0.75": "q3"}
    counts = ["input_rows", "missing_count", "parseable_count", "unparseable_count"]
    return summary.select(*counts, *[F.col(f"`{name}`").cast("string").alias(out) for name, out in texts.items()])


def normalized_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suggestions accepted, each listed twice; every row stays."""
    source = part(spark, sf_dir)
    suggested = tc.normalization_suggestions(source, ["p_name"])
    return tc.apply_suggestions(source, suggested.unionAll(suggested), ["p_name"]).to_df(["p_partkey", "p_name"])


def columns_in_order(by: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ordered = tc.order_columns(tc.column_completeness(orders(spark, sf_dir)), by)
        # One row per column: few enough for one window over the order they come in.
        placed = ordered.withColumn("place", F.monotonically_increasing_id())
        position = F.row_number().over(Window.orderBy("place"))
        return placed.select(position.cast("long").alias("position"), "column_name", "missing_share")

    return query


def entry(spark: SparkSession) -> DataFrame:
    source = orders(spark, SMOKE_DIR)
    return tc.completeness_patterns(source, ["status", "priority", "order_date", "qty_text"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    two = ["status", "priority"]
    return {
        **LLM_QUERIES,
        # completeness
        "row_count_lineitem": lambda s, d: tc.row_count(plain(s, d, "lineitem")),
        "column_completeness_orders": lambda s, d: tc.column_completeness(orders(s, d)),
        "column_completeness_lineitem": lambda s, d: tc.column_completeness(plain(s, d, "lineitem")),
        "dataset_health_orders": lambda s, d: tc.dataset_health(tc.column_completeness(orders(s, d))),
        "completeness_levels_orders": lambda s, d: tc.with_level(tc.column_completeness(orders(s, d))).select(
            "column_name", "present_share", "level"
        ),
        "columns_by_missing_share_orders": columns_in_order("missing"),
        "columns_by_present_share_orders": columns_in_order("present"),
        "columns_in_source_order_orders": columns_in_order("source"),
        "completeness_export_orders": lambda s, d: tc.completeness_export(tc.column_completeness(orders(s, d))),
        # patterns
        "completeness_patterns_orders": lambda s, d: tc.completeness_patterns(orders(s, d), two),
        "completeness_patterns_orders_all": lambda s, d: tc.completeness_patterns(
            orders(s, d), identifier="o_orderkey"
        ),
        "completeness_patterns_events": lambda s, d: tc.completeness_patterns(
            events(s, d), ["event_type", "ts_text", "props"]
        ),
        "completeness_report_orders": lambda s, d: tc.completeness_from_counts(
            tc.pattern_counts(orders(s, d), two), orders(s, d), two
        ),
        "top_patterns_orders": lambda s, d: tc.top_entries(
            tc.completeness_patterns(orders(s, d), ["status", "priority", "order_date", "qty_text"]),
            ["status", "priority", "order_date", "qty_text"],
        ),
        "patterns_filtered_orders": lambda s, d: tc.filter_patterns(
            tc.completeness_patterns(orders(s, d), two), {"status": "missing", "priority": "any"}
        ),
        "pattern_export_orders": lambda s, d: tc.patterns_export(tc.completeness_patterns(orders(s, d), two)),
        "pattern_preview_orders": lambda s, d: tc.pattern_preview(orders(s, d), two, "o_orderkey"),
        "pattern_preview_limits_orders": lambda s, d: tc.pattern_preview(
            orders(s, d), [*two, "qty_text"], "o_orderkey", first_rows_limit=5, extra_rows_limit=7
        ),
        "pattern_preview_documents": lambda s, d: tc.pattern_preview(
            plain(s, d, "documents", "doc_id"), ["text", "lang"], "doc_id"
        ),
        # terms
        "formal_terms_events": lambda s, d: tc.formal_terms(events(s, d), ["event_type", "props"]),
        "formal_terms_orders": lambda s, d: tc.formal_terms(orders(s, d), [*two, "order_date", "qty_text"]),
        "formal_terms_documents": lambda s, d: tc.formal_terms(
            plain(s, d, "documents"), ["text", "lang", "source"]
        ),
        "structural_formats_part": lambda s, d: tc.structural_formats(part(s, d), ["p_brand", "export_text"]),
        "structural_formats_orders": lambda s, d: tc.structural_formats(
            orders(s, d), ["order_date", "qty_text", "code", "o_custkey"]
        ),
        "distinct_terms_orders": lambda s, d: tc.distinct_terms(orders(s, d), [*two, "qty_text"]),
        "top_terms_part": lambda s, d: tc.top_terms(part(s, d), ["p_brand", "p_type", "p_name"]),
        "top_terms_events": lambda s, d: tc.top_terms(events(s, d), ["event_type", "props"], 5),
        # groups
        "group_data_orders": lambda s, d: tc.group_data(orders(s, d), ["status", "o_custkey"]),
        "group_data_lineitem": lambda s, d: tc.group_data(
            plain(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
        ),
        "top_groups_orders": lambda s, d: tc.top_entries(
            tc.group_data(orders(s, d), ["status", "o_custkey"]), ["status", "o_custkey"]
        ),
        "key_uniqueness_orders": lambda s, d: tc.key_uniqueness(orders(s, d), ["status", "o_custkey"]),
        "key_uniqueness_lineitem": lambda s, d: tc.key_uniqueness(
            plain(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
        ),
        # summary tables
        "summary_filter_terms_orders": lambda s, d: tc.filter_summary(
            tc.formal_terms(orders(s, d), ["priority", "qty_text"]),
            {"column_name": {"kind": "exact", "value": "qty_text"}, "value": {"kind": "contains", "value": "1E"}},
        ),
        "summary_missing_terms_orders": lambda s, d: tc.filter_summary(
            tc.formal_terms(orders(s, d), two), {"value": {"kind": "missing"}}
        ),
        "summary_sorted_terms_part": lambda s, d: tc.sort_summary(
            tc.formal_terms(part(s, d), ["p_name"]), "value", keys=["value"], locale_text=True
        ),
        "summary_canonical_positions_orders": lambda s, d: tc.canonical_order(
            tc.formal_terms(orders(s, d), ["status", "priority", "qty_text"]), ["column_name", "value"], position="position"
        ),
        "summary_sorted_positions_orders": lambda s, d: tc.sort_summary(
            tc.formal_terms(orders(s, d), ["status", "priority", "order_date"]), "value", True, ["column_name"], position="position"
        ),
        "rows_head_orders": lambda s, d: tc.head(orders(s, d), 100).to_df(["o_orderkey", "code", "priority"]),
        "row_positions_lineitem": lambda s, d: with_row_position(read(s, d, "lineitem")).select("row_position", "l_orderkey", "l_linenumber"),
        # contracts
        "contract_orders": lambda s, d: tc.evaluate_contract(orders(s, d), CONTRACT),
        "contract_events": lambda s, d: tc.evaluate_contract(events(s, d), EVENTS_CONTRACT),
        # transformations
        "transform_split_orders": lambda s, d: tc.transform(orders(s, d), SPLIT_RULES).to_df(
            ["o_orderkey", "first", "rest", "last", "second", "fourth", "number"]
        ),
        "transform_substring_customer": lambda s, d: tc.transform(
            plain(s, d, "customer", "c_custkey"), SUBSTRING_RULES
        ).to_df(["c_custkey", "head", "cut", "tail", "middle", "near_end"]),
        "transform_regex_pages": lambda s, d: tc.transform(
            plain(s, d, "pages", "page_id"),
            [
                rule("html", "title", "regex_extract", pattern=r"<title>([^<]*)</title>"),
                rule("url", "path", "regex_extract", pattern=r"^(?P<scheme>\w+)://([^/]+)", group=2),
            ],
        ).to_df(["page_id", "title", "path"]),
        "transform_regex_any_case_documents": lambda s, d: tc.transform(
            plain(s, d, "documents", "doc_id"),
            [rule("text", "found", "regex_extract", pattern="(?i)(the [a-z]+)")],
        ).to_df(["doc_id", "found"]),
        "transform_date_events": lambda s, d: tc.transform(events(s, d), DATE_RULES).to_df(
            ["event_id", "day", "clock", "hour_text", "minute_text"]
        ),
        "transform_case_part": lambda s, d: tc.transform(part(s, d), CASE_RULES).to_df(
            ["p_partkey", "p_name", "upper_name", "lower_name", "title_name"]
        ),
        "transform_stats_orders": lambda s, d: tc.transform_statistics(orders(s, d), STATISTICS_RULES),
        "transform_preview_orders": lambda s, d: tc.transform_preview(
            orders(s, d), [rule("code", None, "delimiter_split")]
        ).select("original_o_orderkey", "original_code", "transformed_code"),
        # rows behind an entry
        "rows_by_status": lambda s, d: tc.rows_with_status(orders(s, d), "status", "missing").to_df(),
        "rows_by_pattern": lambda s, d: tc.rows_with_pattern(
            orders(s, d), {"status": "missing", "priority": "present"}
        ).to_df(),
        "rows_by_term": lambda s, d: tc.rows_with_term(orders(s, d), "status", "F").to_df(),
        "rows_by_missing_term": lambda s, d: tc.rows_with_term(orders(s, d), "priority", None).to_df(),
        "rows_by_format": lambda s, d: tc.rows_with_format(part(s, d), "p_brand", "Brand#<2 digits>").to_df(),
        "rows_by_group": lambda s, d: tc.rows_in_group(orders(s, d), {"status": None, "priority": "1-URGENT"}).to_df(),
        "row_filters_orders": lambda s, d: tc.project(
            tc.filter_rows(
                tc.rows_with_pattern(orders(s, d), {"status": "present"}),
                {"code": {"kind": "contains", "value": "ord_1"}, "priority": {"kind": "missing"}},
            ),
            ["code", "priority", "status"],
            "analysis",
        ),
        "row_filters_documents": lambda s, d: tc.filter_rows(
            plain(s, d, "documents"), {"text": {"kind": "contains", "value": "ESS"}}
        ).to_df(["doc_id", "lang", "text"]),
        "row_filter_exact_part": lambda s, d: tc.filter_rows(
            part(s, d), {"p_name": {"kind": "exact", "value": " red widget "}}
        ).to_df(),
        "rows_page_orders": lambda s, d: tc.page(
            tc.filter_rows(orders(s, d), {"priority": {"kind": "missing"}}), 2
        ),
        "rows_page_deep_lineitem": lambda s, d: tc.page(
            plain(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 1001
        ),
        "rows_page_deep_ties_lineitem": lambda s, d: tc.page(
            plain(s, d, "lineitem", "l_quantity", "l_linenumber"), 1001
        ).select("l_quantity", "l_linenumber"),
        "row_numbers_orders": lambda s, d: tc.number_rows(orders(s, d)).select(
            F.col("order0").alias("o_orderkey"), "row_number"
        ),
        # text
        "inert_export_part": lambda s, d: part(s, d).df.select(
            F.col("f0").alias("p_partkey"), tc.inert_text(F.col("f4")).alias("export_text")
        ),
        "row_export_lines_orders": lambda s, d: tc.csv_lines(
            orders(s, d).to_df(["code", "status", "priority", "qty_text"])
        ),
        "casefold_documents": lambda s, d: read(s, d, "documents").select(
            "doc_id", text_functions.casefold(F.col("text")).alias("folded")
        ),
        "shortened_documents": lambda s, d: read(s, d, "documents").select(
            "doc_id", text_functions.shorten(F.col("text")).alias("preview")
        ),
        "structural_format_pages": lambda s, d: read(s, d, "pages").select(
            "page_id", text_functions.structural_format(F.col("url")).alias("format")
        ),
        "csv_roundtrip_orders": csv_roundtrip,
        "csv_multiline_documents": csv_multiline,
        "csv_single_column_documents": csv_single_column,
        "transformed_export_lines_orders": lambda s, d: tc.csv_lines(
            tc.transform(orders(s, d), RAW_RULES).to_df(["code", "status", "tail"]), inert=False
        ),
        # profiles and comparisons
        "column_profile_orders": lambda s, d: tc.column_profile(orders(s, d)),
        "snapshot_diff_orders": snapshot_diff,
        "numeric_summary_orders": lambda s, d: tc.value_summary(orders(s, d), "qty_text", "number"),
        "integer_summary_orders": integer_summary,
        "date_summary_orders": lambda s, d: tc.value_summary(orders(s, d), "order_date", "YYYY-MM-DD"),
        "histogram_orders": lambda s, d: tc.histogram(orders(s, d), "qty_text", "integer", 8),
        "date_counts_orders": lambda s, d: tc.date_counts(orders(s, d), "order_date", interval="month"),
        "week_counts_events": lambda s, d: tc.date_counts(
            events(s, d), "ts_text", "YYYY-MM-DD HH:MM:SS", "week"
        ),
        "normalization_suggestions_part": lambda s, d: tc.normalization_suggestions(part(s, d), ["p_name"]),
        "normalized_part": normalized_part,
        "key_reference_orders_customer": lambda s, d: tc.key_reference_check(
            orders(s, d), ["o_custkey"], plain(s, d, "customer"), ["c_custkey"]
        ),
    }


# --- the same results as SQL ---------------------------------------------------------------------


def with_views(body: str) -> str:
    used = [name for name in VIEWS if name in body]
    ctes = [f"{name} as ({VIEWS[name].replace('{' + VIEW_SOURCE[name] + '}', VIEW_SOURCE[name])})" for name in used]
    if not ctes:
        return body
    joined = ", ".join(ctes)
    return f"with {joined}, {body[5:]}" if body.startswith("with ") else f"with {joined} {body}"


def missing(column: str, *markers: str) -> str:
    listed = ", ".join(f"'{marker.lower()}'" for marker in markers)
    among = f" or lower(trim({column})) in ({listed})" if markers else ""
    return f"({column} is null or trim({column}) = ''{among})"


NO_STATUS = missing("status", "n/a")
NO_PRIORITY = missing("priority", "n/a")
ORDERS_MISSING = {
    "o_orderkey": "(o_orderkey is null)",
    "o_custkey": "(o_custkey is null)",
    "status": NO_STATUS,
    "priority": NO_PRIORITY,
    "order_date": missing("order_date"),
    "qty_text": missing("qty_text"),
    "code": missing("code"),
}


def completeness_sql(source: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"select {i} as column_index, '{name}' as column_name, count(*) as input_rows, "
        f"count(*) filter (not {gone}) as present_count, "
        f"count(*) filter (not {gone}) / count(*) as present_share, "
        f"count(*) filter ({gone}) as missing_count, count(*) filter ({gone}) / count(*) as missing_share "
        f"from {source}"
        for i, (name, gone) in enumerate(columns.items())
    )


def patterns_sql(source: str, columns: dict[str, str], count: str = "count", share: str = "share") -> str:
    statuses = ", ".join(f"case when {gone} then 'missing' else 'present' end as {name}" for name, gone in columns.items())
    keys = ", ".join(str(i + 1) for i in range(len(columns)))
    return (
        f"select {statuses}, count(*) as \"{count}\", count(*) / (select count(*) from {source}) as {share} "
        f"from {source} group by {keys}"
    )


def terms_sql(source: str, columns: dict[str, tuple[int, str]]) -> str:
    return " union all ".join(
        f"select {index} as column_index, '{name}' as column_name, "
        f"case when not {gone} then cast({name} as string) end as value, count(*) as \"count\", "
        f"count(*) / (select count(*) from {source}) as share from {source} group by 3"
        for name, (index, gone) in columns.items()
    )


ORDERS_TERMS = {name: (i, gone) for i, (name, gone) in enumerate(ORDERS_MISSING.items())}
FORMAT = (
    "list_aggregate(list_transform(regexp_extract_all({0}, '([0-9]+|[^0-9]+)'), lambda t: "
    "case when regexp_matches(t, '^[0-9]') then '<' || length(t) || ' digits>' else t end), 'string_agg', '')"
)


def formats_sql(terms: str) -> str:
    shape = FORMAT.format("value")
    return (
        f"with terms as ({terms}), shaped as (select *, {shape} as pattern from terms where regexp_matches(value, '[0-9]')) "
        "select column_index, column_name, pattern, cast(sum(\"count\") as bigint) as occurrence_count, "
        "count(*) as distinct_term_count, cast(sum(\"count\") as double) / "
        "(select sum(\"count\") / count(distinct column_index) from terms) as share "
        "from shaped group by 1, 2, 3 having count(*) >= 2"
    )


def top_terms_sql(terms: str, limit: int) -> str:
    return (
        f"with terms as ({terms}), ranked as (select *, row_number() over (partition by column_index "
        "order by \"count\" desc, value) as rank, sum(\"count\") over (partition by column_index) as present "
        "from terms where value is not null) "
        "select column_index, column_name, cast(rank as integer) as rank, value, \"count\", share, "
        f"\"count\" / cast(present as double) as share_of_present from ranked where rank <= {limit}"
    )


def groups_sql(source: str, keys: dict[str, str]) -> str:
    values = ", ".join(f"case when not {gone} then cast({name} as string) end as {name}" for name, gone in keys.items())
    numbers = ", ".join(str(i + 1) for i in range(len(keys)))
    return (
        f"select {values}, count(*) as \"count\", count(*) / (select count(*) from {source}) as share "
        f"from {source} group by {numbers}"
    )


def uniqueness_sql(groups: str) -> str:
    return (
        f"with groups as ({groups}) select count(*) as distinct_key_count, "
        "count(*) filter (\"count\" = 1) as singleton_key_count, "
        "count(*) filter (\"count\" > 1) as repeated_key_count, "
        "cast(coalesce(sum(\"count\") filter (\"count\" > 1), 0) as bigint) as input_rows_in_repeated_key_groups, "
        "count(*) filter (\"count\" = 1) / count(*) as singleton_key_share from groups"
    )


def contract_sql(source: str, rules: list[tuple[str, str | None]]) -> str:
    """Each rule: the missing condition, and the passing condition (None for a required rule)."""
    parts = []
    for index, (gone, check) in enumerate(rules):
        passing = f"not {gone}" if check is None else f"not {gone} and ({check})"
        failing = gone if check is None else f"not {gone} and not ({check})"
        parts.append(
            f"select {index} as rule_index, count(*) as input_rows, count(*) filter ({gone}) as missing_count, "
            f"count(*) filter ({passing}) as passing_count, count(*) filter ({failing}) as failing_count from {source}"
        )
    return " union all ".join(parts)


NUMBER = "regexp_matches(trim({0}), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
INTEGER = "regexp_matches(trim({0}), '^[+-]?[0-9]+$')"
DATE = (
    "regexp_matches(trim({0}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(trim({0}) as date) is not null"
)
DATETIME = (
    "regexp_matches(trim({0}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') "
    "and try_cast(trim({0}) as timestamp) is not null"
)
INERT = "case when regexp_matches(ltrim({0}), '^[=+@-]') then '''' || {0} else {0} end"
CSV_FIELD = "case when regexp_matches({0}, '[,\"]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"


def export_field(column: str) -> str:
    return f"coalesce({CSV_FIELD.format('(' + INERT.format(column) + ')')}, '')"


def summary_sql(parsed: str, gone: str, quantiles: str) -> str:
    return (
        f"with typed as (select *, {parsed} as v, {gone} as gone from orders_dirty) select count(*) as input_rows, "
        "count(*) filter (gone) as missing_count, count(v) as parseable_count, "
        "count(*) filter (not gone and v is null) as unparseable_count, "
        f"min(v) as min_value, max(v) as max_value, {quantiles} from typed"
    )


def integer_summary_sql() -> str:
    def quantile(q: float) -> str:
        low, high = f"(select v from r where k = floor({q} * (n - 1)) + 1)", f"(select v from r where k = ceil({q} * (n - 1)) + 1)"
        part = f"(select {q} * (n - 1) - floor({q} * (n - 1)) from r limit 1)"
        return f"cast(cast({low} as decimal(38, 6)) + cast(cast({high} - {low} as double) * {part} as decimal(38, 6)) as varchar)"

    return (
        f"with s as (select nullif({LARGE_INTEGER}, '') as t from orders), "
        "r as (select cast(t as hugeint) as v, row_number() over (order by cast(t as hugeint)) as k, count(*) over () as n from s where t is not null) "
        "select (select count(*) from s) as input_rows, (select count(*) from s where t is null) as missing_count, "
        "(select count(*) from r) as parseable_count, cast(0 as bigint) as unparseable_count, "
        "cast((select min(v) from r) as varchar) as min_value, cast((select max(v) from r) as varchar) as max_value, "
        f"{quantile(0.25)} as q1, {quantile(0.5)} as q2, {quantile(0.75)} as q3"
    )


def profile_sql(source: str, columns: dict[str, str]) -> str:
    indexed = {name: (i, gone) for i, (name, gone) in enumerate(columns.items())}
    terms = terms_sql(source, indexed)
    return (
        f"with c as ({completeness_sql(source, columns)}), t as ({terms}), "
        "d as (select column_index, count(*) as distinct_term_count from t group by 1), "
        "top as (select * from (select *, row_number() over (partition by column_index order by \"count\" desc, value) as rn, "
        "sum(\"count\") over (partition by column_index) as present from t where value is not null) where rn = 1), "
        "f as (select column_index, count(*) as format_count, cast(sum(n) as bigint) as rows_with_format from "
        f"(select column_index, {FORMAT.format('value')} as pattern, sum(\"count\") as n "
        "from t where regexp_matches(value, '[0-9]') group by 1, 2 having count(*) >= 2) group by 1) "
        "select c.*, d.distinct_term_count, d.distinct_term_count / c.input_rows as distinct_term_share, "
        "top.value as top_term, top.\"count\" as top_term_count, "
        "top.\"count\" / cast(top.present as double) as top_term_share_of_present, "
        "coalesce(f.format_count, 0) as format_count, coalesce(f.rows_with_format, 0) as rows_with_format "
        "from c join d using (column_index) left join top using (column_index) left join f using (column_index)"
    )


def snapshot_sql() -> str:
    before = {**ORDERS_MISSING, "priority": missing("priority")}
    after = {name: before[name] for name in ("o_custkey", "status", "qty_text", "code")}
    return (
        f"with reduced as (select o_custkey, {LATER_STATUS} as status, qty_text, code from orders_dirty), "
        f"b as ({profile_sql('orders_dirty', before)}), a as ({profile_sql('reduced', after)}) "
        "select coalesce(b.column_name, a.column_name) as column_name, "
        "case when b.column_name is null then 'added' when a.column_name is null then 'removed' "
        "when a.column_index <> b.column_index then 'reordered' else 'same' end as column_change, "
        "a.input_rows - b.input_rows as input_rows_change, "
        "b.missing_count as missing_count_before, a.missing_count as missing_count_after, "
        "b.distinct_term_count as distinct_term_count_before, a.distinct_term_count as distinct_term_count_after, "
        "b.format_count as format_count_before, a.format_count as format_count_after, "
        "a.rows_with_format - b.rows_with_format as rows_with_format_change "
        "from b full outer join a on a.column_name = b.column_name"
    )


def rows_sql(condition: str, source: str = "orders_dirty") -> str:
    return f"select * from {source} where {condition}"


def oracle_sql() -> dict[str, str]:
    two = {"status": NO_STATUS, "priority": NO_PRIORITY}
    four = {name: ORDERS_MISSING[name] for name in ("status", "priority", "order_date", "qty_text")}
    never = "(false)"
    lineitem = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    events_terms = {"event_type": (1, missing("event_type", "none")), "props": (3, missing("props"))}
    part_terms = {"p_brand": (1, never), "p_type": (2, never), "p_name": (3, never)}
    orders_terms = {name: ORDERS_TERMS[name] for name in four}
    custkey_groups = groups_sql("orders_dirty", {"status": NO_STATUS, "o_custkey": never})
    completeness = completeness_sql("orders_dirty", ORDERS_MISSING)
    preview = (
        "with ranked as (select case when {status} then 'missing' else 'present' end as status_status, "
        "case when {priority} then 'missing' else 'present' end as status_priority{more_status}, "
        "o_orderkey, status, priority, qty_text from orders_dirty), "
        "numbered as (select *, row_number() over (partition by {keys} order by o_orderkey) as preview_rank from ranked)"
    )
    sql = {
        "row_count_lineitem": "select count(*) as input_rows from lineitem",
        "column_completeness_orders": completeness,
        "column_completeness_lineitem": completeness_sql(
            "lineitem", {name: f"({name} is null)" for name in lineitem}
        ),
        "dataset_health_orders": f"with c as ({completeness}) select "
        "cast(sum(input_rows) as bigint) as total_cells, cast(sum(present_count) as bigint) as present_cells, "
        "cast(sum(missing_count) as bigint) as missing_cells, "
        "cast(sum(present_count) as double) / cast(sum(input_rows) as double) as completeness_share, "
        "count(*) filter (missing_count > 0) as columns_with_missing from c",
        "completeness_levels_orders": f"with c as ({completeness}) select column_name, present_share, "
        "case when floor(present_share * 100 + 0.5) < 50 then 'low' "
        "when floor(present_share * 100 + 0.5) < 90 then 'moderate' else 'high' end as level from c",
        "columns_by_present_share_orders": f"with c as ({completeness}) select "
        "row_number() over (order by present_share desc, column_index) as position, column_name, missing_share from c",
        "columns_in_source_order_orders": f"with c as ({completeness}) select "
        "row_number() over (order by column_index) as position, column_name, missing_share from c",
        "columns_by_missing_share_orders": f"with c as ({completeness}) select "
        "row_number() over (order by missing_share desc, column_index) as position, column_name, missing_share from c",
        "completeness_export_orders": f"with c as ({completeness}) select column_name as \"column\", input_rows, "
        "present_count as input_rows_with_value, present_share as share_with_value, "
        "missing_count as input_rows_missing_value, missing_share as share_missing_value from c",
        "completeness_patterns_orders": patterns_sql("orders_dirty", two),
        "completeness_patterns_orders_all": patterns_sql(
            "orders_dirty", {name: gone for name, gone in ORDERS_MISSING.items() if name != "o_orderkey"}
        ),
        "completeness_patterns_events": patterns_sql(
            "events_text",
            {"event_type": missing("event_type", "none"), "ts_text": missing("ts_text"), "props": missing("props")},
        ),
        "completeness_report_orders": completeness,
        "top_patterns_orders": f"select * from ({patterns_sql('orders_dirty', four)}) "
        "order by \"count\" desc, status, priority, order_date, qty_text limit 10",
        "patterns_filtered_orders": f"select * from ({patterns_sql('orders_dirty', two)}) where status = 'missing'",
        "pattern_export_orders": patterns_sql("orders_dirty", two, "input_rows", "share_of_input_rows"),
        "pattern_preview_orders": preview.format(
            status=NO_STATUS, priority=NO_PRIORITY, more_status="", keys="status_status, status_priority"
        )
        + " select status_status, status_priority, cast(preview_rank as integer) as preview_rank, "
        "cast(o_orderkey as string) as identifier_value, status as value_status, priority as value_priority "
        "from numbered where preview_rank <= 5",
        "pattern_preview_limits_orders": preview.format(
            status=NO_STATUS,
            priority=NO_PRIORITY,
            more_status=f", case when {missing('qty_text')} then 'missing' else 'present' end as status_qty_text",
            keys="status_status, status_priority, status_qty_text",
        )
        + ", first as (select * from numbered where preview_rank = 1 order by o_orderkey limit 5), "
        "extra as (select n.* from numbered n semi join first f using (status_status, status_priority, status_qty_text) "
        "where n.preview_rank between 2 and 5 order by n.o_orderkey limit 7) "
        "select status_status, status_priority, status_qty_text, cast(preview_rank as integer) as preview_rank, "
        "cast(o_orderkey as string) as identifier_value, status as value_status, priority as value_priority, "
        "qty_text as value_qty_text from (select * from first union all select * from extra)",
        "pattern_preview_documents": "select 'present' as status_text, 'present' as status_lang, "
        "cast(row_number() over (order by doc_id) as integer) as preview_rank, cast(doc_id as string) as identifier_value, "
        "case when length(text) > 256 then substring(text, 1, 256) || '...' else text end as value_text, "
        "lang as value_lang from documents order by doc_id limit 5",
        "formal_terms_events": terms_sql("events_text", events_terms),
        "formal_terms_orders": terms_sql("orders_dirty", orders_terms),
        "formal_terms_documents": terms_sql(
            "documents", {"text": (1, missing("text")), "lang": (2, never), "source": (3, never)}
        ),
        "structural_formats_part": formats_sql(
            terms_sql("part_text", {"p_brand": (1, never), "export_text": (4, never)})
        ),
        "structural_formats_orders": formats_sql(
            terms_sql("orders_dirty", {n: ORDERS_TERMS[n] for n in ("order_date", "qty_text", "code", "o_custkey")})
        ),
        "distinct_terms_orders": f"with terms as ({terms_sql('orders_dirty', {n: ORDERS_TERMS[n] for n in (*two, 'qty_text')})}) "
        "select column_index, column_name, count(*) as distinct_term_count, cast(sum(\"count\") as bigint) as input_rows "
        "from terms group by 1, 2",
        "top_terms_part": top_terms_sql(terms_sql("part_text", part_terms), 10),
        "group_data_orders": custkey_groups,
        "group_data_lineitem": groups_sql(
            "lineitem", {"l_returnflag": never, "l_linestatus": never, "l_linenumber": never}
        ),
        "top_groups_orders": f"select * from ({custkey_groups}) "
        "order by \"count\" desc, status nulls first, o_custkey nulls first limit 10",
        "key_uniqueness_orders": uniqueness_sql(custkey_groups),
        "key_uniqueness_lineitem": uniqueness_sql(
            groups_sql("lineitem", {"l_orderkey": never, "l_linenumber": never})
        ),
        "summary_filter_terms_orders": f"select * from ({terms_sql('orders_dirty', {'qty_text': ORDERS_TERMS['qty_text']})}) "
        "where contains(lower(value), '1e')",
        "summary_missing_terms_orders": f"select * from ({terms_sql('orders_dirty', {n: ORDERS_TERMS[n] for n in two})}) "
        "where value is null",
        "summary_sorted_terms_part": terms_sql("part_text", {"p_name": (3, never)}),
        "summary_canonical_positions_orders": f"select *, row_number() over (order by \"count\" desc, column_name, value nulls first) as position "
        f"from ({terms_sql('orders_dirty', {n: ORDERS_TERMS[n] for n in ('status', 'priority', 'qty_text')})})",
        "summary_sorted_positions_orders": "select *, row_number() over (order by value desc nulls last, \"count\" desc, column_name) as position "
        f"from ({terms_sql('orders_dirty', {n: ORDERS_TERMS[n] for n in ('status', 'priority', 'order_date')})})",
        "rows_head_orders": "select o_orderkey, code, priority from orders_dirty order by o_orderkey limit 100",
        "row_positions_lineitem": "select row_number() over () - 1 as row_position, l_orderkey, l_linenumber from lineitem",
        "contract_orders": contract_sql(
            "orders_dirty",
            [
                (NO_STATUS, None),
                (NO_STATUS, "status in ('F', 'O')"),
                (missing("qty_text"), INTEGER.format("qty_text")),
                (missing("qty_text"), NUMBER.format("qty_text")),
                (missing("order_date"), DATE.format("order_date")),
                (NO_PRIORITY, None),
            ],
        ),
        "contract_events": contract_sql(
            "events_text",
            [
                (missing("event_type", "none"), None),
                (missing("ts_text"), DATETIME.format("ts_text")),
                (missing("ts_text"), DATE.format("ts_text")),
            ],
        ),
        "transform_split_orders": "select o_orderkey, 'ORD' as first, substring(code, 5) as rest, "
        "split_part(code, '_', -1) as last, split_part(code, '_', 2) as second, code as fourth, "
        "split_part(code, '_', 2) as number from orders_dirty",
        "transform_substring_customer": "select c_custkey, substring(c_name, 1, 4) as head, "
        "substring(c_name, 1, length(c_name) - 3) as cut, right(c_name, 5) as tail, "
        "substring(c_name, 3, 6) as middle, substring(c_name, length(c_name) - 5, 3) as near_end from customer",
        "transform_regex_pages": "select page_id, case when regexp_matches(html, '<title>([^<]*)</title>') "
        "then regexp_extract(html, '<title>([^<]*)</title>', 1) else html end as title, "
        "case when regexp_matches(url, '^(\\w+)://([^/]+)') then regexp_extract(url, '^(\\w+)://([^/]+)', 2) "
        "else url end as path from pages",
        "transform_regex_any_case_documents": "select doc_id, case when regexp_matches(text, '(?i)(the [a-z]+)') "
        "then regexp_extract(text, '(?i)(the [a-z]+)', 1) else text end as found from documents",
        "transform_date_events": "select event_id, substring(ts_text, 1, 10) as day, substring(ts_text, 12) as clock, "
        "substring(ts_text, 1, 13) as hour_text, substring(ts_text, 15) as minute_text from events_text",
        "transform_case_part": "select p_partkey, trim(p_name) as p_name, upper(trim(p_name)) as upper_name, "
        "lower(p_name) as lower_name, substring(list_aggregate(list_transform(string_split(lower(trim(p_name)), ' '), "
        "lambda w: ' ' || upper(substring(w, 1, 1)) || substring(w, 2)), 'string_agg', ''), 2) as title_name from part_text",
        "transform_stats_orders": "with o as (select *, coalesce(trim(status), '') = '' as no_s, "
        "coalesce(trim(order_date), '') = '' as no_d, coalesce(trim(qty_text), '') = '' as no_q from orders_dirty) "
        "select 0 as rule_index, 'substring_letter' as rule_id, count(*) filter (not no_s) as matched_count, "
        "cast(0 as bigint) as unmatched_count, count(*) filter (no_s) as empty_count, count(*) as total_rows from o "
        "union all select 1, 'regex_extract_year', count(*) filter (not no_d and regexp_matches(order_date, '^[0-9]{4}-[0-9]{2}-')), "
        "count(*) filter (not no_d and not regexp_matches(order_date, '^[0-9]{4}-[0-9]{2}-')), "
        "count(*) filter (no_d), count(*) from o "
        "union all select 2, 'delimiter_split_split', count(*) filter (not no_q and contains(qty_text, ',')), "
        "count(*) filter (not no_q and not contains(qty_text, ',')), count(*) filter (no_q), count(*) from o "
        "union all select 3, 'case_trim_skipped', 0, 0, 0, count(*) from o",
        "transform_preview_orders": "select cast(o_orderkey as string) as original_o_orderkey, code as original_code, "
        "substring(code, 5) as transformed_code from orders_dirty order by o_orderkey limit 25",
        "rows_by_status": rows_sql(NO_STATUS),
        "rows_by_pattern": rows_sql(f"{NO_STATUS} and not {NO_PRIORITY}"),
        "rows_by_term": rows_sql("status = 'F'"),
        "rows_by_missing_term": rows_sql(NO_PRIORITY),
        "rows_by_format": rows_sql("regexp_matches(p_brand, '^Brand#[0-9]{2}$')", "part_text"),
        "rows_by_group": rows_sql(f"{NO_STATUS} and priority = '1-URGENT'"),
        "row_filters_orders": f"select status, priority, code from orders_dirty where not {NO_STATUS} "
        f"and contains(lower(code), 'ord_1') and {NO_PRIORITY}",
        "row_filters_documents": "select doc_id, lang, text from documents "
        "where contains(replace(lower(text), 'ß', 'ss'), 'ess')",
        "row_filter_exact_part": rows_sql("p_name = ' red widget '", "part_text"),
        "rows_page_orders": rows_sql(NO_PRIORITY) + " order by o_orderkey limit 50 offset 50",
        "rows_page_deep_lineitem": "select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey "
        "limit 50 offset 50000",
        "rows_page_deep_ties_lineitem": "select l_quantity, l_linenumber from lineitem "
        "order by l_quantity, l_linenumber limit 50 offset 50000",
        "row_numbers_orders": "select o_orderkey, row_number() over (order by o_orderkey) as row_number from orders",
        "inert_export_part": f"select p_partkey, {INERT.format('export_text')} as export_text from part_text",
        "row_export_lines_orders": "select concat_ws(',', "
        + ", ".join(export_field(name) for name in ("code", "status", "priority", "qty_text"))
        + ") as line from orders_dirty",
        "casefold_documents": "select doc_id, replace(lower(text), 'ß', 'ss') as folded from documents",
        "shortened_documents": "select doc_id, case when length(text) > 256 then substring(text, 1, 256) || '...' "
        "else text end as preview from documents",
        "structural_format_pages": f"select page_id, case when regexp_matches(url, '[0-9]') then {FORMAT.format('url')} end "
        "as format from pages",
        "csv_roundtrip_orders": patterns_sql("orders_dirty", four),
        "csv_multiline_documents": "select cast(doc_id as varchar) as doc_id, md5(nullif(text, '')) as text_md5, "
        "cast(length(nullif(text, '')) as int) as text_length, lang, source, cast(n_chars as varchar) as n_chars from documents",
        "csv_single_column_documents": "select md5(nullif(text, '')) as text_md5, count(*) as input_rows from documents group by 1",
        "transformed_export_lines_orders": "select concat_ws(',', code, coalesce(status, ''), coalesce(substr(order_date, 5), '')) as line from orders_dirty",
        "column_profile_orders": profile_sql("orders_dirty", ORDERS_MISSING),
        "snapshot_diff_orders": snapshot_sql(),
        "numeric_summary_orders": summary_sql(
            f"case when {NUMBER.format('qty_text')} then try_cast(qty_text as double) end",
            missing("qty_text"),
            "quantile_cont(v, 0.25) as \"q0.25\", quantile_cont(v, 0.5) as \"q0.5\", quantile_cont(v, 0.75) as \"q0.75\"",
        ),
        "date_summary_orders": summary_sql(
            f"case when {DATE.format('order_date')} then try_cast(order_date as date) end",
            missing("order_date"),
            "quantile_disc(v, 0.25) as \"q0.25\", quantile_disc(v, 0.5) as \"q0.5\", quantile_disc(v, 0.75) as \"q0.75\"",
        ),
        "histogram_orders": f"with v as (select cast(qty_text as double) as v from orders_dirty where {INTEGER.format('qty_text')}), "
        "b as (select min(v) as low, max(v) as high, count(*) as n from v), "
        "c as (select cast(least(floor((v - low) / (high - low) * 8), 7) as integer) as bin, count(*) as n from v, b group by 1) "
        "select cast(r.range as integer) as bin, low + (high - low) / 8 * r.range as lower_bound, "
        "low + (high - low) / 8 * (r.range + 1) as upper_bound, coalesce(c.n, 0) as \"count\", coalesce(c.n, 0) / b.n as share "
        "from range(8) r cross join b left join c on c.bin = r.range",
        "date_counts_orders": f"with v as (select cast(order_date as date) as v from orders_dirty where {DATE.format('order_date')}) "
        "select cast(date_trunc('month', v) as date) as period, count(*) as \"count\", "
        "count(*) / (select count(*) from v) as share from v group by 1",
        "week_counts_events": "with v as (select cast(ts_text as timestamp) as v from events_text) "
        "select cast(date_trunc('week', v) as date) as period, count(*) as \"count\", "
        "count(*) / (select count(*) from v) as share from v group by 1",
        "integer_summary_orders": integer_summary_sql(),
        "normalized_part": "with t as (select p_name as v, count(*) as n, lower(trim(p_name)) as k from part_text group by 1), "
        "l as (select k, trim(v) as proposed from (select *, row_number() over (partition by k order by n desc, v) as rn, "
        "count(*) over (partition by k) as terms from t) where rn = 1 and terms > 1) "
        "select p_partkey, coalesce(proposed, p_name) as p_name from part_text left join l on l.k = lower(trim(p_name))",
        "normalization_suggestions_part": "with t as (select p_name as original_term, count(*) as \"count\", "
        "lower(trim(p_name)) as k from part_text group by 1), g as (select k, count(*) as term_count, "
        "cast(sum(\"count\") as bigint) as group_rows from t group by 1 having count(*) > 1), "
        "l as (select k, trim(original_term) as proposed_text from (select *, row_number() over "
        "(partition by k order by \"count\" desc, original_term) as rn from t) where rn = 1) "
        "select 3 as column_index, 'p_name' as column_name, original_term, \"count\", proposed_text, term_count, group_rows "
        "from t join g using (k) join l using (k)",
        "key_reference_orders_customer": "with l as (select o_custkey as k, count(*) as n from orders group by 1), "
        "r as (select c_custkey as k, count(*) as n from customer group by 1), "
        "j as (select l.n as ln, r.n as rn from l full outer join r using (k)) "
        "select count(ln) as left_keys, count(rn) as right_keys, count(*) filter (ln is not null and rn is not null) as matched_keys, "
        "count(*) filter (rn is null) as left_unmatched_keys, count(*) filter (ln is null) as right_unmatched_keys, "
        "cast(coalesce(sum(ln) filter (rn is not null), 0) as bigint) as left_matched_rows, "
        "cast(coalesce(sum(ln) filter (rn is null), 0) as bigint) as left_unmatched_rows, "
        "cast(0 as bigint) as left_missing_key_rows, cast(0 as bigint) as right_missing_key_rows from j",
        "top_terms_events": top_terms_sql(terms_sql("events_text", events_terms), 5),
    }
    return {**{name: with_views(body) for name, body in sql.items()}, **LLM_ORACLES}
