"""Which combinations of present and missing columns occur, and what such rows look like.

Rows are grouped on packed status bits (see ``masks``), which keeps hashing and the shuffle cheap;
the status texts are written only for the distinct patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import MISSING, PRESENT
from ..functions.text import shorten
from ..plans.selection import ColumnSelectionError, choose_columns
from ..table import Table, by_position, exact_position
from .completeness import completeness_rows
from .masks import is_present, mask_names, packed_rows
from .shares import share_of, total_of

WIDE_SELECTION = 20

# How many example rows are kept.
PREVIEW_ROWS = 5


def _selected(
    source: Table, columns: Sequence[str] | None, identifier: str | None, allow_wide: bool
) -> tuple[str, ...]:
    if identifier is not None and not identifier.strip():
        identifier = None
    requested = source.names if columns is None else columns
    chosen = choose_columns(source.names, requested, identifier)
    if len(chosen) >= WIDE_SELECTION and not allow_wide:
        raise ColumnSelectionError(
            f"{len(chosen)} columns allow 2^{len(chosen)} patterns; pass allow_wide=True."
        )
    return chosen


def _statuses(columns: Sequence[str]) -> list[Column]:
    return [
        F.when(is_present(i), F.lit(PRESENT)).otherwise(F.lit(MISSING)).alias(f"s{i}")
        for i in range(len(columns))
    ]


def completeness_patterns(
    source: Table,
    columns: Sequence[str] | None = None,
    identifier: str | None = None,
    allow_wide: bool = False,
) -> DataFrame:
    """Exact count and share of every pattern: one status column per analysed column.

    The identifier column never takes part. Unordered; see ``summary.canonical_order``.
    """
    chosen = _selected(source, columns, identifier, allow_wide)
    counts = (
        packed_rows(source, chosen)
        .groupBy(*mask_names(chosen))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _pattern_rows(counts, chosen)


def _pattern_rows(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counts.select(
        *_statuses(columns),
        F.col("count"),
        share_of(F.col("count"), total_of(counts)).alias("share"),
    ).toDF(*columns, "count", "share")


def pattern_counts(
    source: Table,
    columns: Sequence[str] | None = None,
    identifier: str | None = None,
    allow_wide: bool = False,
) -> DataFrame:
    """The compact grouped form that holds both column completeness and the patterns.

    One row per pattern. Persist it, then derive ``patterns_from_counts`` and
    ``completeness_from_counts`` without reading the source again.
    """
    chosen = _selected(source, columns, identifier, allow_wide)
    others = [name for name in source.names if name not in chosen]
    other_flags = [source.present(name).alias(f"o{source.position(name)}") for name in others]
    return (
        packed_rows(source, chosen, other_flags)
        .groupBy(*mask_names(chosen))
        .agg(
            F.count(F.lit(1)).alias("count"),
            *[
                F.count_if(F.col(f"o{source.position(name)}")).alias(f"p{source.position(name)}")
                for name in others
            ],
        )
    )


def patterns_from_counts(
    counts: DataFrame,
    source: Table,
    columns: Sequence[str] | None = None,
    identifier: str | None = None,
    allow_wide: bool = False,
) -> DataFrame:
    return _pattern_rows(counts, _selected(source, columns, identifier, allow_wide))


def completeness_from_counts(
    counts: DataFrame,
    source: Table,
    columns: Sequence[str] | None = None,
    identifier: str | None = None,
    allow_wide: bool = False,
) -> DataFrame:
    chosen = _selected(source, columns, identifier, allow_wide)
    present = []
    for i, name in enumerate(source.names):
        if name in chosen:
            part = F.when(is_present(chosen.index(name)), F.col("count")).otherwise(0)
        else:
            part = F.col(f"p{i}")
        present.append(F.coalesce(F.sum(part), F.lit(0)).alias(f"p{i}"))
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("input_rows"), *present)
    return completeness_rows(totals, source.names)


def filter_patterns(patterns: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """Keep patterns whose status for a column is present or missing; ``any`` keeps all."""
    positional, names = by_position(patterns)
    for name, wanted in statuses.items():
        if wanted not in (PRESENT, MISSING, "any"):
            raise ValueError(f"Unknown status {wanted!r}.")
        if wanted != "any":
            positional = positional.where(F.col(f"f{exact_position(names, name)}") == wanted)
    return positional.toDF(*names)


def pattern_preview(
    source: Table,
    columns: Sequence[str] | None = None,
    identifier: str | None = None,
    allow_wide: bool = False,
    rows_per_pattern: int = PREVIEW_ROWS,
    first_rows_limit: int | None = None,
    extra_rows_limit: int | None = None,
) -> DataFrame:
    """The first rows behind every pattern, in source order, with shortened cell texts.

    Every pattern gets its first row before any gets a second; limits hold only where they are given.
    """
    chosen = _selected(source, columns, identifier, allow_wide)
    keys = mask_names(chosen)
    order = source.order_columns()
    order_names = [f"order{i}" for i in range(len(order))]
    identifier_text = (
        shorten(source.text(identifier)) if identifier in source.names else F.lit(None).cast("string")
    )
    rows = packed_rows(
        source,
        chosen,
        [
            *[column.alias(name) for column, name in zip(order, order_names)],
            identifier_text.alias("identifier"),
            *[shorten(source.text(name)).alias(f"v{i}") for i, name in enumerate(chosen)],
        ],
    )
    # Spark keeps at most rows_per_pattern rows of a pattern per input partition before the shuffle.
    ranking = Window.partitionBy(*keys).orderBy(*order_names)
    ranked = rows.withColumn("preview_rank", F.row_number().over(ranking)).where(
        F.col("preview_rank") <= rows_per_pattern
    )
    if first_rows_limit is not None or extra_rows_limit is not None:
        ranked = _within_limits(ranked, keys, order_names, first_rows_limit, extra_rows_limit)
    return ranked.select(
        *_statuses(chosen),
        "preview_rank",
        "identifier",
        *[f"v{i}" for i in range(len(chosen))],
    ).toDF(
        *[f"status_{name}" for name in chosen],
        "preview_rank",
        "identifier_value",
        *[f"value_{name}" for name in chosen],
    )


def _within_limits(
    ranked: DataFrame, masks: list[str], order: list[str], first_limit: int | None, extra_limit: int | None
) -> DataFrame:
    # Only the narrow keys are sorted for the limits. Joins are left to the optimizer: without a
    # limit, or with a large one, the keys may be many.
    keys = ranked.select(*masks, *order, "preview_rank")
    first = keys.where("preview_rank = 1")
    if first_limit is not None:
        first = first.orderBy(*order).limit(first_limit)
    extra = keys.where("preview_rank > 1").join(first.select(*masks), masks, "left_semi")
    if extra_limit is not None:
        extra = extra.orderBy(*order).limit(extra_limit)
    kept = first.select(*masks, "preview_rank").union(extra.select(*masks, "preview_rank"))
    return ranked.join(kept, [*masks, "preview_rank"], "left_semi")
