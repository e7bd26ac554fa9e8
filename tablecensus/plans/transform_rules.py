"""Transformation rules with their defaults, checked once before any row is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# The rule vocabulary and its defaults.
TARGET_MODES = ("new_column", "overwrite")
TRANSFORM_TYPES = ("date_truncate", "delimiter_split", "substring", "regex_extract", "case_trim")
DEFAULTS = {
    "date_truncate": {"part": "date_only", "delimiter": None},
    "delimiter_split": {"delimiter": "_", "position": "after", "part_index": 1},
    "substring": {"mode": "first_n", "count": 5, "start": 0, "length": 5},
    "regex_extract": {"pattern": "", "group": 1},
    "case_trim": {"trim": True, "case": "none"},
}
WHOLE_NUMBERS = ("part_index", "count", "start", "length", "group")
TEXTS = ("delimiter", "pattern")


class TransformRuleError(ValueError):
    """A transformation rule is malformed."""


@dataclass(frozen=True)
class TransformRule:
    source_column: str
    transform_type: str
    id: str
    target_mode: str
    target_column: str
    config: Mapping[str, object] = field(default_factory=dict)


def parse_rules(rules: Sequence[TransformRule | Mapping[str, object]]) -> list[TransformRule]:
    return [rule if isinstance(rule, TransformRule) else parse_rule(rule) for rule in rules]


def _trimmed(value: object) -> str:
    return str(value).strip()


def _settings(value: object) -> Mapping[str, object]:
    return value if isinstance(value, Mapping) else {}


# Each field of a rule document: what counts where it is left out, and how a given value is read.
FIELDS = {
    "source_column": ("", _trimmed),
    "transform_type": ("delimiter_split", lambda value: value),
    "id": ("", _trimmed),
    "target_mode": ("new_column", lambda value: value),
    "target_column": ("", _trimmed),
    "config": ({}, _settings),
}
# Fields that may stay empty in a document, and what stands for them, from the other fields.
FALLBACKS = {
    "id": "rule_{source_column}",
    "target_column": "{source_column}_transformed",
}


def parse_rule(document: Mapping[str, object]) -> TransformRule:
    given = {name: read(document.get(name, default)) for name, (default, read) in FIELDS.items()}
    faults = {
        "A rule needs a source_column.": not given["source_column"],
        f"The target_mode {given['target_mode']!r} is not known.": given["target_mode"] not in TARGET_MODES,
    }
    for message, found in faults.items():
        if found:
            raise TransformRuleError(message)
    complete = {name: given[name] or text.format(**given) for name, text in FALLBACKS.items()}
    if given["target_mode"] == "overwrite":
        complete["target_column"] = given["source_column"]
    complete["config"] = _complete_config(given["transform_type"], given["config"])
    return TransformRule(**given | complete)


def _complete_config(kind: object, given: Mapping[str, object]) -> dict[str, object]:
    # A type that is not known leaves every value as it is, unmatched.
    config = {**DEFAULTS.get(kind, {}), **given}
    for key in WHOLE_NUMBERS:
        if key in config:
            try:
                config[key] = int(config[key])
            except (TypeError, ValueError) as error:
                raise TransformRuleError(f"{key} must be a whole number.") from error
    for key in TEXTS:
        if config.get(key) is not None and not isinstance(config[key], str):
            raise TransformRuleError(f"{key} must be text.")
    return config
