"""Ordered transformation rules that add or overwrite columns, with match statistics."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyregex import portable_regex
from ..functions.text import is_blank, slice_text, strip, title
from ..plans.selection import unused_name
from ..plans.transform_rules import TransformRule, parse_rules
from ..table import Table, physical
from .details import head

PREVIEW_ROWS = 25

# What counts as a date and as a time of day inside longer text.
DATE_TEXT = r"\b(\d{1,4}[/\-\.]\d{1,2}[/\-\.]\d{1,4})\b"
TIME_TEXT = r"\b(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?)\b"


@dataclass(frozen=True)
class Step:
    """One rule turned into expressions. ``matched`` is NULL for a blank cell."""

    value: Column
    matched: Column


@dataclass(frozen=True)
class _Plan:
    table: Table
    flags: list[str | None]


def _contains(text: Column, part: str) -> Column:
    return text.contains(F.lit(part))


def _before(text: Column, delimiter: str) -> Column:
    return F.substring_index(text, delimiter, 1)


def _after(text: Column, delimiter: str) -> Column:
    return F.substring(text, F.instr(text, F.lit(delimiter)) + F.lit(len(delimiter)), F.length(text))


def _first_match(text: Column, pattern: str) -> Column:
    """The first group of a pattern that cannot match empty text; NULL without a match."""
    return F.nullif(F.regexp_extract(text, portable_regex(pattern).java, 1), F.lit(""))


def _date_truncate(text: Column, config: Mapping[str, object]) -> tuple[Column, Column]:
    part, delimiter = config["part"], config["delimiter"]
    if part == "date_only":
        pattern, separators, cut = DATE_TEXT, (":", " ", "T"), _before
    elif part == "time_only":
        pattern, separators, cut = TIME_TEXT, (" ", "T", ":"), _after
    else:
        return text, F.lit(False)
    options = []
    if delimiter:
        options.append(F.when(_contains(text, delimiter), strip(cut(text, delimiter))))
    options.append(_first_match(text, pattern))
    for separator in separators:
        candidate = strip(cut(text, separator))
        # Decimal digits and digits like superscripts both count as a digit.
        usable = _contains(text, separator) & candidate.rlike(_digit_class())
        options.append(F.when(usable, candidate))
    found = F.coalesce(*options)
    return F.coalesce(found, text), found.isNotNull()


@lru_cache(maxsize=None)
def _digit_class() -> str:
    others = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal()]
    # Long character classes are slow in Java, so plain text is settled by its own part.
    return r"[0-9]|(?=[^\x00-\x7f])[\p{Nd}" + "".join(others) + "]"


def _delimiter_split(text: Column, config: Mapping[str, object]) -> tuple[Column, Column]:
    delimiter, position = config["delimiter"], config["position"]
    if not delimiter:
        return text, F.lit(False)
    matched = _contains(text, delimiter)
    if position in ("before", "before_first"):
        part = _before(text, delimiter)
    elif position == "after":
        part = _after(text, delimiter)
    elif position == "after_last":
        # Counted from the right, also when occurrences of the delimiter overlap.
        part = F.substring_index(text, delimiter, -1)
    elif position == "part_index":
        index = config["part_index"]
        if not 1 <= index < 2**31:
            return text, F.lit(False)
        pieces = F.split_part(text, F.lit(delimiter), F.lit(index))
        removed = F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))
        matched = matched & (F.lit(index - 1) * len(delimiter) <= removed)
        part = pieces
    else:
        return text, F.lit(False)
    return F.when(matched, part).otherwise(text), matched


def _substring(text: Column, config: Mapping[str, object]) -> tuple[Column, Column]:
    mode, count = config["mode"], config["count"]
    start, length = config["start"], config["length"]
    if mode == "first_n":
        return slice_text(text, None, count), F.lit(True)
    if mode == "last_n":
        return (slice_text(text, -count, None) if count > 0 else text), F.lit(True)
    if mode == "range":
        return slice_text(text, start, start + length if length > 0 else None), F.lit(True)
    return text, F.lit(False)


def _regex_extract(text: Column, config: Mapping[str, object]) -> tuple[Column, Column]:
    pattern, group = config["pattern"], config["group"]
    if not pattern:
        return text, F.lit(False)
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return text, F.lit(False)
    group = group if 0 <= group <= groups else 0
    portable = portable_regex(pattern)
    if portable is None or (
        group and portable.may_be_empty[group] and portable.may_be_unset[group]
    ):
        # Java cannot tell a group that took no part from one that matched nothing.
        result = _python_search(pattern, group)(text)
        return result["value"], result["matched"]
    matched = text.rlike(portable.java)
    extract = F.regexp_extract(text, portable.java, group)
    if group and not portable.may_be_empty[group]:
        # Found text is never empty, so most rows are settled by one evaluation.
        value = F.coalesce(F.nullif(extract, F.lit("")), F.when(~matched, text))
    else:
        value = F.when(matched, extract).otherwise(text)
    return value, matched


def _python_search(pattern: str, group: int):
    """``re.search`` in Arrow batches, for patterns without an equal Java form."""

    @F.pandas_udf("value string, matched boolean")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = re.compile(pattern)
        for texts in batches:
            hits = [None if text is None else compiled.search(text) for text in texts]
            values = [text if hit is None else hit.group(group) for text, hit in zip(texts, hits)]
            matched = [hit is not None for hit in hits]
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "matched": matched})

    return search


def _case_trim(text: Column, config: Mapping[str, object]) -> tuple[Column, Column]:
    base = strip(text) if config["trim"] else text
    cases = {"upper": F.upper, "lower": F.lower, "title": title}
    case = config["case"]
    return (cases[case](base) if case in cases else base), F.lit(True)


TRANSFORMS = {
    "date_truncate": _date_truncate,
    "delimiter_split": _delimiter_split,
    "substring": _substring,
    "regex_extract": _regex_extract,
    "case_trim": _case_trim,
}


def compile_rule(text: Column, rule: TransformRule) -> Step:
    """Blank cells pass through unchanged and belong to neither side of the statistics."""
    blank = text.isNull() | is_blank(text)
    transform = TRANSFORMS.get(rule.transform_type)
    value, matched = transform(text, rule.config) if transform else (text, F.lit(False))
    return Step(F.when(blank, text).otherwise(value), F.when(~blank, matched))


def _apply(source: Table, rules: Sequence[TransformRule], keep_flags: bool) -> _Plan:
    current, flags = source, []
    for index, rule in enumerate(rules):
        if rule.source_column not in current.names:
            flags.append(None)
            continue
        step = compile_rule(current.text(rule.source_column), rule)
        names, target = current.names, rule.source_column
        if rule.target_mode == "new_column":
            target = unused_name(rule.target_column, names)
            names = (*names, target)
        slot = physical(names.index(target))
        added = {slot: step.value}
        if keep_flags:
            added[f"matched{index}"] = step.matched
        flags.append(f"matched{index}")
        current = replace(current, df=current.df.withColumns(added), names=names)
    return _Plan(current, flags)


def transform(source: Table, rules: Sequence[TransformRule | Mapping[str, object]]) -> Table:
    """Apply the rules in order; a rule may read columns that earlier rules made.

    A rule on an unknown column is skipped. New columns get a free name.
    """
    # A rule may overwrite the column that gives the source order, so that is kept aside first.
    kept = {f"_order{i}": column for i, column in enumerate(source.order_columns())} if source.order else {}
    source = replace(source, df=source.df.withColumns(kept) if kept else source.df, order=tuple(kept))
    return _apply(source, parse_rules(rules), keep_flags=False).table


def transform_statistics(source: Table, rules: Sequence[TransformRule | Mapping[str, object]]) -> DataFrame:
    """Matched, unmatched, empty and total rows of every rule, by rule position and id.

    An aggregate and not an observed metric: repeated tasks would be counted twice there.
    """
    rules = parse_rules(rules)
    plan = _apply(source, rules, keep_flags=True)
    used = [flag for flag in plan.flags if flag]
    counts = plan.table.df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(flag)).alias(f"yes_{flag}") for flag in used],
        *[F.count_if(~F.col(flag)).alias(f"no_{flag}") for flag in used],
    )
    zero = F.lit(0).cast("long")
    entries = []
    for index, (rule, flag) in enumerate(zip(rules, plan.flags)):
        matched = F.col(f"yes_{flag}") if flag else zero
        unmatched = F.col(f"no_{flag}") if flag else zero
        entries.append(
            F.struct(
                F.lit(index).alias("rule_index"),
                F.lit(rule.id).alias("rule_id"),
                matched.alias("matched_count"),
                unmatched.alias("unmatched_count"),
                (F.col("total") - matched - unmatched if flag else zero).alias("empty_count"),
                F.col("total").alias("total_rows"),
            )
        )
    return counts.select(F.inline(F.array(*entries)))


def transform_preview(
    source: Table, rules: Sequence[TransformRule | Mapping[str, object]], rows: int = PREVIEW_ROWS
) -> DataFrame:
    """The first rows with the original and the transformed cells side by side."""
    first = head(source, rows)
    kept = {f"original{i}": first.text(name) for i, name in enumerate(first.names)}
    before = replace(first, df=first.df.withColumns(kept))
    after = transform(before, rules)
    ordered = after.df.orderBy(*after.order_columns())
    return ordered.select(
        *[F.col(name) for name in kept],
        *[after.text(name) for name in after.names],
    ).toDF(
        *[f"original_{name}" for name in first.names],
        *[f"transformed_{name}" for name in after.names],
    )


def preview_statistics(
    source: Table, rules: Sequence[TransformRule | Mapping[str, object]], rows: int = PREVIEW_ROWS
) -> DataFrame:
    return transform_statistics(head(source, rows), rules)
