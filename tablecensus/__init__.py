"""Table profiling and data-quality checks as lazy Spark DataFrames."""

from .operators.completeness import (
    column_completeness,
    dataset_health,
    order_columns,
    row_count,
    with_level,
)
from .operators.contracts import evaluate_contract
from .operators.details import (
    filter_rows,
    head,
    in_source_order,
    number_rows,
    page,
    page_index,
    page_of_numbered,
    project,
    row_total,
    rows_in_group,
    rows_with_format,
    rows_with_pattern,
    rows_with_status,
    rows_with_term,
)
from .operators.groups import group_counts, group_data, key_uniqueness
from .operators.patterns import (
    completeness_from_counts,
    completeness_patterns,
    filter_patterns,
    pattern_counts,
    pattern_preview,
    patterns_from_counts,
)
from .operators.profile import (
    column_profile,
    compare_snapshots,
    load_snapshot,
    save_snapshot,
    snapshot_of,
    snapshot_settings,
)
from .operators.references import key_reference_check
from .operators.suggestions import apply_suggestions, normalization_suggestions
from .operators.summary import canonical_order, filter_summary, sort_summary, top_entries
from .operators.terms import distinct_terms, formal_terms, structural_formats, term_counts, top_terms
from .operators.transforms import (
    preview_statistics,
    transform,
    transform_preview,
    transform_statistics,
)
from .operators.typed import date_counts, histogram, parse_counts, value_summary
from .plans.contract import parse_contract
from .sinks.csv import (
    completeness_export,
    csv_lines,
    inert_text,
    patterns_export,
    write_csv,
    write_rows,
)
from .sources.csv import read_csv
from .sources.row_ids import with_file_row_id, with_row_position
from .table import Table, require_rows, table

__all__ = [name for name in dir() if not name.startswith("_")]
