"""Count how many rows miss, pass and fail every rule of a data contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import is_date, is_datetime, is_integer, is_number
from ..plans.contract import Contract, Rule, bind_contract, parse_contract
from ..table import Table


def passes(source: Table, rule: Rule) -> Column:
    """Does a value that is not missing satisfy the rule?"""
    text = source.text(rule.column)
    if rule.kind == "required":
        return F.lit(True)
    if rule.kind == "enum":
        return text.isin(list(rule.values))
    checks = {
        ("integer", None): is_integer,
        ("number", None): is_number,
        ("date", "YYYY-MM-DD"): is_date,
        ("date", "YYYY-MM-DD HH:MM:SS"): is_datetime,
    }
    return checks[rule.value_type, rule.date_format](text)


def evaluate_contract(source: Table, contract: Contract | str | Mapping[str, object]) -> DataFrame:
    """One row per rule: ``rule_index, input_rows, missing_count, passing_count, failing_count``.

    One scan of the columns that rules name. Missing values fail a required rule and are neither
    passing nor failing for every other rule.
    """
    contract = contract if isinstance(contract, Contract) else parse_contract(contract)
    bind_contract(contract, source.names)
    columns = list(dict.fromkeys(rule.column for rule in contract.rules))
    present = {name: F.col(f"present{i}") for i, name in enumerate(columns)}
    checked = source.df.select(
        *[source.present(name).alias(f"present{i}") for i, name in enumerate(columns)],
        *[
            F.when(source.present(rule.column), passes(source, rule)).alias(f"pass{i}")
            for i, rule in enumerate(contract.rules)
            if rule.kind != "required"
        ],
    )
    counts = checked.agg(
        F.count(F.lit(1)).alias("input_rows"),
        *[F.count_if(column).alias(f"n_present{i}") for i, column in enumerate(present.values())],
        *[
            F.count_if(F.col(f"pass{i}")).alias(f"n_pass{i}")
            for i, rule in enumerate(contract.rules)
            if rule.kind != "required"
        ],
    )
    return counts.select(F.inline(F.array(*[_result(i, rule, columns) for i, rule in enumerate(contract.rules)])))


def _result(index: int, rule: Rule, columns: list[str]) -> Column:
    rows = F.col("input_rows")
    present = F.col(f"n_present{columns.index(rule.column)}")
    missing = rows - present
    if rule.kind == "required":
        passing, failing = present, missing
    else:
        passing = F.col(f"n_pass{index}")
        failing = present - passing
    return F.struct(
        F.lit(index).alias("rule_index"),
        rows.alias("input_rows"),
        missing.alias("missing_count"),
        passing.alias("passing_count"),
        failing.alias("failing_count"),
    )
