"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers do the rest.

The automaton knows at-signs, schemes, plus-signs, pairs of digits as they occur in addresses and
numbers, and words that announce an account. From each cue a deterministic parser walks to both
ends of the candidate and validates it, so that no pattern is tried at any other place.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order in a digest; the last three are additions to the base.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
BASE = KINDS[:4]
#: Words that announce an account number, in small letters; they also count with a capital or in capitals.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
#: Bytes of text that a worker handles at once.
HELD = 1 << 22

DIGITS = frozenset(string.digits)
LETTERS = frozenset(string.ascii_letters)
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = LETTERS | DIGITS | frozenset("+.-")
CAPITALS = frozenset(string.ascii_uppercase) | DIGITS
#: What ends the part of an address that may hold a login.
AUTHORITY_END = frozenset(" \t\n\v\f\r/?#\"'<>")

Span = tuple[int, int, int]


def spellings(word: str) -> tuple[str, str, str]:
    return word, word.capitalize(), word.upper()


def automaton() -> ahocorasick.Automaton:
    """Cues with the kind of parser they start and their length."""
    cues: dict[str, str] = {"@": "email", "+": "phone", "://": "login"}
    cues |= {f"{a}.": "ip" for a in string.digits}
    cues |= {f"{a}{gap}{b}": "card" for a in string.digits for b in string.digits for gap in ("", " ", "-")}
    cues |= {s: "iban" for s in spellings("iban")}
    cues |= {s: "account" for word in ACCOUNT_CUES for s in spellings(word)}
    out = ahocorasick.Automaton()
    for cue, kind in cues.items():
        out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


def forward(text: str, at: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters that begins at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def backward(text: str, at: int, allowed: frozenset[str], least: int) -> int:
    """The start of the run of allowed characters that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


# Each parser gets the text, the bounds of its cue and the end of the last match of its kind, and
# returns (start, end, valid, next), or None: nothing else of this kind is looked for before ``next``.


def email(text: str, start: int, end: int, least: int):
    begin = backward(text, start, LOCAL, least)
    label = forward(text, end, LABEL)
    if begin == start or label == end:
        return None
    stop = label
    while stop < len(text) and text[stop] == "." and (after := forward(text, stop + 1, LABEL)) > stop + 1:
        stop = after
    return (begin, stop, True, stop) if stop > label else None


def ip(text: str, start: int, end: int, least: int):
    begin, ends = backward(text, start, DIGITS, least), []
    stop = begin
    while stop < len(text) and (after := forward(text, stop, DIGITS)) > stop:
        ends.append(after)
        if len(ends) == 4:
            parts = text[begin:after].split(".")
            return begin, after, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts), after
        if after == len(text) or text[after] != ".":
            break
        stop = after + 1
    # Fewer than four parts: no later part of this chain can begin a match.
    return begin, begin, False, ends[-1]


def numbered(text: str, at: int) -> int:
    """The end of the digits from ``at`` on, with at most one space or hyphen between two of them."""
    n = len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    return at


def card(text: str, start: int, end: int, least: int):
    stop = numbered(text, start)
    digits = [int(c) for c in text[start:stop] if c in DIGITS]
    return start, stop, 14 <= len(digits) <= 19 and luhn(digits), stop


def luhn(digits: list[int]) -> bool:
    doubled = [2 * x - 9 * (x > 4) for x in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def phone(text: str, start: int, end: int, least: int):
    if end == len(text) or text[end] not in DIGITS:
        return None
    stop = forward(text, end + 1, PHONE)
    while text[stop - 1] not in DIGITS:
        stop -= 1
    if stop < end + 3:
        return None
    return start, stop, 10 <= sum(c in DIGITS for c in text[start:stop]) <= 15, stop


def login(text: str, start: int, end: int, least: int):
    """An address with a login before its host: scheme://name:secret@host, up to the end of the host."""
    begin = backward(text, start, SCHEME, least)
    while begin < start and text[begin] not in LETTERS:
        begin += 1
    if begin == start:
        return None
    stop = end
    while stop < len(text) and text[stop] not in AUTHORITY_END:
        stop += 1
    at = text.rfind("@", end, stop)
    return (begin, stop, end < at < stop - 1, stop) if stop > end else None


def after_cue(text: str, end: int) -> int:
    """Where the value after a cue word begins: spaces, colons, number signs and dots are passed."""
    return forward(text, end, frozenset(" :#.="))


def iban(text: str, start: int, end: int, least: int):
    """Two capitals, two digits, then capitals and digits with single spaces; the check number decides."""
    begin, n = after_cue(text, end), len(text)
    stop = begin + 4
    if not (LETTERS & CAPITALS).issuperset(text[begin : begin + 2]) or not DIGITS.issuperset(text[begin + 2 : stop]) or stop > n:
        return None
    while stop < n and (text[stop] in CAPITALS or text[stop : stop + 1] == " " and CAPITALS.issuperset(text[stop + 1 : stop + 2] or "-")):
        stop += 1 + (text[stop] == " ")
    value = text[begin:stop].replace(" ", "")
    rest = 0
    for c in value[4:] + value[:4]:
        rest = (rest * (10 if c in DIGITS else 100) + int(c, 36)) % 97
    return begin, stop, 15 <= len(value) <= 34 and rest == 1, stop


def account(text: str, start: int, end: int, least: int):
    """Six to 18 digits after a word for an account."""
    begin = after_cue(text, end)
    if begin == len(text) or text[begin] not in DIGITS:
        return None
    stop = numbered(text, begin)
    return (begin, stop, True, stop) if 6 <= sum(c in DIGITS for c in text[begin:stop]) <= 18 else None


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "login": login, "iban": iban, "account": account}


def spans_of(text: str, cues: ahocorasick.Automaton) -> list[Span]:
    """(start, kind number, end) of all personal data, in order."""
    found: list[Span] = []
    reached = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in cues.iter(text):
        start = last + 1 - size
        if start < reached[kind]:
            continue
        hit = PARSERS[kind](text, start, last + 1, reached[kind])
        if hit:
            begin, end, valid, reached[kind] = hit
            if valid:
                found.append((begin, KINDS.index(kind), end))
    return sorted(found)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame, redact: bool = False) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are code points, end exclusive. Base kinds follow the contract (leftmost, not overlapping
    within a kind, invalid matches dropped without a second try); added are logins in addresses,
    IBANs and account numbers behind a word that announces them. Null and empty texts have no
    spans, repeated rows and ids count each for itself, other columns are ignored, an empty table
    gives an empty result. The work on a text grows with its length. With ``redact`` a column
    ``text`` holds the text with each span replaced by ``[KIND]`` (overlapping spans by the first one's).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = automaton()
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # As many rows as stay below the bound, one at least.
                full = int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, side="right"))
                yield answer(batch.slice(at, max(full - at, 1)), cues)
                at = max(full, at + 1)

    def answer(part: pa.RecordBatch, cues: ahocorasick.Automaton) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(1).to_pylist()]
        spans = [spans_of(t, cues) for t in texts]
        base = [[s for s in found if s[1] < len(BASE)] for found in spans]
        columns = [part.column(0)]
        columns += [pa.array([sum(s[1] == k for s in found) for found in base], pa.int64()) for k in range(len(BASE))]
        columns.append(pa.array([hashlib.sha256(digest(found).encode()).hexdigest() for found in base], pa.string()))
        columns.append(pa.array([digest(found) for found in spans], pa.string()))
        if redact:
            columns.append(pa.array([redacted(t, found) for t, found in zip(texts, spans, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans", *(["text"] if redact else [])]
    kinds = ["long", *("long" for _ in BASE), "string", "string", *(["string"] if redact else [])]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def redacted(text: str, spans: list[Span]) -> str:
    out, at, end = [], 0, 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])
