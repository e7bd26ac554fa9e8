"""Run Python regular expressions on Spark's regex functions where both mean the same.

Python parses the pattern; the parsed form is written out in the Java dialect with the Unicode
classes spelled out. Anything the two engines treat differently gives no Java pattern, and the
caller then evaluates the pattern with ``re`` in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as _codes
    from re import _parser
except ImportError:  # without the parsed form every pattern is evaluated with ``re``
    _codes = _parser = None

SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
LONGEST_GROUP_REPEAT = 100


class NotPortable(Exception):
    pass


@dataclass(frozen=True)
class PortableRegex:
    java: str
    groups: int
    # Per group: can it match the empty text, and can it be skipped by a successful match?
    may_be_empty: dict[int, bool]
    may_be_unset: dict[int, bool]


def portable_regex(pattern: str) -> PortableRegex | None:
    """The Java form of a Python pattern, or None. Raises ``re.error`` for an invalid pattern."""
    compiled = re.compile(pattern)
    if _parser is None or compiled.flags & ~(re.UNICODE | re.VERBOSE | re.DOTALL):
        return None
    tree = _parser.parse(pattern)
    writer = _Writer(dot_all=bool(compiled.flags & re.DOTALL))
    try:
        java = writer.sequence(tree, optional=False)
    except NotPortable:
        return None
    return PortableRegex(java, compiled.groups, writer.may_be_empty, writer.may_be_unset)


def _literal(code: int) -> str:
    character = chr(code)
    return character if character.isascii() and character.isalnum() else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, dot_all: bool) -> None:
        self.dot_all = dot_all
        self.may_be_empty: dict[int, bool] = {}
        self.may_be_unset: dict[int, bool] = {}

    def sequence(self, items, optional: bool) -> str:
        return "".join(self.item(op, arg, optional) for op, arg in items)

    def item(self, op, arg, optional: bool) -> str:
        name = str(op)
        method = getattr(self, "write_" + name.lower(), None)
        if method is None:
            raise NotPortable(name)
        return method(arg, optional)

    def write_literal(self, code, optional):
        return _literal(code)

    def write_not_literal(self, code, optional):
        return f"[^{_literal(code)}]"

    def write_any(self, arg, optional):
        return "(?s:.)" if self.dot_all else "[^\\n]"

    def write_in(self, members, optional):
        negated = False
        parts = []
        for op, arg in members:
            name = str(op)
            if name == "NEGATE":
                negated = True
            elif name == "LITERAL":
                parts.append(_literal(arg))
            elif name == "RANGE":
                parts.append(f"{_literal(arg[0])}-{_literal(arg[1])}")
            elif name == "CATEGORY":
                parts.append(self._category(str(arg), alone=len(members) == 1))
            else:
                raise NotPortable(name)
        if negated and any(part.startswith("[^") for part in parts):
            raise NotPortable("complement inside a complement")
        return "[" + ("^" if negated else "") + "".join(parts) + "]"

    def _category(self, name: str, alone: bool) -> str:
        kind = name.removeprefix("CATEGORY_")
        members = {"DIGIT": DIGIT, "SPACE": SPACE, "WORD": WORD}.get(kind.removeprefix("NOT_"))
        if members is None:
            raise NotPortable(name)
        if not kind.startswith("NOT_"):
            return members
        return "^" + members if alone else f"[^{members}]"

    def write_branch(self, arg, optional):
        return "(?:" + "|".join(self.sequence(choice, True) for choice in arg[1]) + ")"

    def write_subpattern(self, arg, optional):
        group, add_flags, del_flags, content = arg
        if add_flags or del_flags:
            raise NotPortable("scoped flags")
        if group is None:
            return f"(?:{self.sequence(content, optional)})"
        self.may_be_empty[group] = content.getwidth()[0] == 0
        self.may_be_unset[group] = optional
        return f"({self.sequence(content, optional)})"

    def _repeat(self, arg, optional, suffix):
        low, high, content = arg
        unbounded = high == _codes.MAXREPEAT
        single = len(content) == 1 and str(content[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY")
        # Java recurses per iteration of a group, and captures inside repeats that can match
        # nothing differ; both go to the Python side.
        if not single and (unbounded or int(high) > LONGEST_GROUP_REPEAT or content.getwidth()[0] == 0):
            raise NotPortable("repeat of a group")
        inner = self.sequence(content, optional or low == 0)
        bounds = f"{{{low},{'' if unbounded else int(high)}}}"
        return (inner if single else f"(?:{inner})") + bounds + suffix

    def write_max_repeat(self, arg, optional):
        return self._repeat(arg, optional, "")

    def write_min_repeat(self, arg, optional):
        return self._repeat(arg, optional, "?")

    def write_possessive_repeat(self, arg, optional):
        return self._repeat(arg, optional, "+")

    def write_atomic_group(self, content, optional):
        return f"(?>{self.sequence(content, optional)})"

    def write_assert(self, arg, optional):
        return f"(?{'=' if arg[0] > 0 else '<='}{self.sequence(arg[1], optional)})"

    def write_assert_not(self, arg, optional):
        return f"(?{'!' if arg[0] > 0 else '<!'}{self.sequence(arg[1], True)})"

    def write_groupref(self, group, optional):
        return f"(?:\\{group})"

    def write_at(self, position, optional):
        inside, before, after = f"[{WORD}]", f"(?<=[{WORD}])", f"(?<![{WORD}])"
        places = {
            "AT_BEGINNING": "\\A",
            "AT_BEGINNING_STRING": "\\A",
            "AT_END": "(?=\\n?\\z)",
            "AT_END_STRING": "\\z",
            "AT_BOUNDARY": f"(?:{before}(?!{inside})|{after}(?={inside}))",
            "AT_NON_BOUNDARY": f"(?:{before}(?={inside})|{after}(?!{inside}))",
        }
        if str(position) not in places:
            raise NotPortable(str(position))
        return places[str(position)]
