"""Version 1 of the data contract document."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

# The contract format.
VERSION = 1
VALUE_TYPES = ("integer", "number", "date")
DATE_FORMATS = ("YYYY-MM-DD", "YYYY-MM-DD HH:MM:SS")


class ContractError(ValueError):
    """The document is not a valid contract, or a rule does not fit the table."""


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    values: tuple[str, ...] = ()
    value_type: str | None = None
    date_format: str | None = None


@dataclass(frozen=True)
class Contract:
    rules: tuple[Rule, ...]


def parse_contract(document: str | Mapping[str, object]) -> Contract:
    """Read a contract from JSON text or from the decoded object. All or nothing."""
    if isinstance(document, str):
        try:
            document = json.loads(document, parse_constant=_no_constant)
        except json.JSONDecodeError as error:
            raise ContractError("The contract is not valid JSON.") from error
    _check_fields(document, "contract", "version", "rules")
    version = document["version"]
    if isinstance(version, bool) or not isinstance(version, (int, float)) or version != VERSION:
        raise ContractError(f"Contract version {version!r} is not supported, only {VERSION} is.")
    rules = document["rules"]
    if not isinstance(rules, list) or not rules:
        raise ContractError("A contract needs a list of at least one rule.")
    return Contract(tuple(_parse_rule(rule) for rule in rules))


def bind_contract(contract: Contract, names: Sequence[str]) -> Contract:
    """Every rule must name exactly one column, case included."""
    for rule in contract.rules:
        hits = list(names).count(rule.column)
        if hits != 1:
            problem = "does not exist" if hits == 0 else "is ambiguous"
            raise ContractError(f"The contract column {rule.column!r} {problem}.")
    return contract


def _no_constant(text: str):
    raise ContractError(f"{text} is not allowed in a contract.")


def _check_fields(document: object, what: str, *fields: str) -> None:
    if not isinstance(document, Mapping):
        raise ContractError(f"The {what} must be an object.")
    if set(document) != set(fields):
        odd = sorted(map(str, set(document) ^ set(fields)))
        raise ContractError(f"The {what} has missing or unknown fields: {', '.join(odd)}.")


def _parse_rule(rule: object) -> Rule:
    if not isinstance(rule, Mapping):
        raise ContractError("A contract rule must be an object.")
    kind = rule.get("kind")
    if kind == "required":
        _check_fields(rule, "required rule", "column", "kind")
        return Rule(_column(rule), kind)
    if kind == "enum":
        _check_fields(rule, "enum rule", "column", "kind", "values")
        return Rule(_column(rule), kind, values=_enum_values(rule["values"]))
    if kind == "type":
        value_type = rule.get("value_type")
        if not isinstance(value_type, str) or value_type not in VALUE_TYPES:
            raise ContractError(f"The value type {value_type!r} is not supported.")
        if value_type != "date":
            _check_fields(rule, f"{value_type} rule", "column", "kind", "value_type")
            return Rule(_column(rule), kind, value_type=value_type)
        _check_fields(rule, "date rule", "column", "kind", "value_type", "date_format")
        date_format = rule["date_format"]
        if not isinstance(date_format, str) or date_format not in DATE_FORMATS:
            raise ContractError(f"The date format must be one of {', '.join(DATE_FORMATS)}.")
        return Rule(_column(rule), kind, value_type=value_type, date_format=date_format)
    raise ContractError(f"The rule kind {kind!r} is not supported.")


def _column(rule: Mapping[str, object]) -> str:
    if not isinstance(rule["column"], str):
        raise ContractError("The column of a rule must be text.")
    return rule["column"]


def _enum_values(values: object) -> tuple[str, ...]:
    if not isinstance(values, list) or not values:
        raise ContractError("An enum rule needs a list of values.")
    if not all(isinstance(value, str) and value.strip() for value in values):
        raise ContractError("Enum values must be text that is not blank.")
    if len(set(values)) < len(values):
        raise ContractError("Enum values must differ from each other.")
    return tuple(values)
