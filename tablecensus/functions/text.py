"""Text functions that follow Python's rules, written as native Spark expressions."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT_RUN = "[0-9]+"
CASED_RUN = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"
UNCASED_RUN = r"[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"
ELLIPSIS = "..."


@lru_cache(maxsize=None)
def whitespace() -> str:
    """Every character that ``str.strip`` removes (Spark's ``trim`` only knows U+0020)."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@lru_cache(maxsize=None)
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Case folding of single characters: one-to-one pairs, and the ones that grow."""
    single, growing = {}, {}
    for character in map(chr, range(sys.maxunicode + 1)):
        folded = character.casefold()
        if folded != character:
            (single if len(folded) == 1 else growing)[character] = folded
    return single, growing


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(whitespace()))


def starts_visibly(text: Column) -> Column:
    """Is the first character a visible ASCII one? Strings compare by bytes, so this is cheap."""
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def is_blank(text: Column) -> Column:
    # Trimming one side is enough, and most values are settled by their first byte.
    return F.when(starts_visibly(text), F.lit(False)).otherwise(
        F.ltrim(text, F.lit(whitespace())) == F.lit("")
    )


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def casefold(text: Column) -> Column:
    """``str.casefold`` for any text. ASCII rows take the plain ``lower`` path."""
    single, growing = fold_tables()
    folded = F.translate(text, "".join(single), "".join(single.values()))
    # The one common growing character has its own step. Java tests long character classes one
    # by one, so the others are only looked for behind a cheap test for the first 256 characters.
    sharp_s = "ß"
    folded = F.replace(folded, F.lit(sharp_s), F.lit(growing[sharp_s]))
    rare = "".join(c for c in growing if c != sharp_s)
    pieces = F.regexp_extract_all(
        folded, F.lit(rf"([\x00-\xff]+|[{rare}]|[^\x00-\xff{rare}]+)"), F.lit(0)
    )
    growth = F.create_map(*[F.lit(part) for c in rare for part in (c, growing[c])])
    expanded = F.array_join(
        F.transform(pieces, lambda piece: F.coalesce(F.try_element_at(growth, piece), piece)), ""
    )
    grows = folded.rlike(rf"(?=[^\x00-\xff])[{rare}]")
    return F.when(is_ascii(text), F.lower(text)).otherwise(
        F.when(grows, expanded).otherwise(folded)
    )


def fold_towards(text: Column, targets: list[str]) -> Column:
    """Case folding that is exact for comparisons with the given folded texts.

    Only characters whose folding shares a character with a target can change the outcome of an
    equality or substring test, so the expression stays small and inside generated code.
    """
    wanted = set("".join(targets))
    single, growing = fold_tables()
    pairs = {c: f for c, f in single.items() if f in wanted}
    folded = F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text
    for character, expansion in growing.items():
        if wanted & set(expansion):
            folded = F.replace(folded, F.lit(character), F.lit(expansion))
    return folded


def contains_casefolded(text: Column, needle: str) -> Column:
    folded_needle = needle.casefold()
    folded = F.when(is_ascii(text), F.lower(text)).otherwise(fold_towards(text, [folded_needle]))
    return text.isNotNull() & folded.contains(F.lit(folded_needle))


def title(text: Column) -> Column:
    """``str.title``: a word starts after any uncased character, so ``o'neil`` has two."""
    runs = F.regexp_extract_all(text, F.lit(f"({CASED_RUN}|{UNCASED_RUN})"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def structural_format(text: Column) -> Column:
    """Each run of ASCII digits becomes ``<n digits>``; NULL when there is no digit."""
    runs = F.regexp_extract_all(text, F.lit(f"({DIGIT_RUN}|[^0-9]+)"), F.lit(0))
    widths = F.transform(
        runs,
        lambda run: F.when(
            run.rlike("^[0-9]"), F.concat(F.lit("<"), F.length(run).cast("string"), F.lit(" digits>"))
        ).otherwise(run),
    )
    return F.when(text.rlike("[0-9]"), F.array_join(widths, ""))


def format_skeleton(text: Column) -> Column:
    """The text with every ASCII digit as 0: equal for two texts exactly when their formats are."""
    return F.translate(text, "123456789", "0" * 9)


def shorten(text: Column, limit: int = 256) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def slice_text(text: Column, start: int | None, stop: int | None) -> Column:
    """``text[start:stop]`` with Python's meaning of negative and oversized bounds."""
    size = F.length(text)

    def bound(position: int) -> Column:
        position = max(-(2**30), min(2**30, position))
        if position < 0:
            return F.greatest(size + F.lit(position), F.lit(0))
        return F.least(F.lit(position), size)

    first = bound(start) if start else F.lit(0)
    last = size if stop is None else bound(stop)
    return F.substring(text, first + F.lit(1), F.greatest(last - first, F.lit(0)))


def double_text(number: Column) -> Column:
    """The shortest text that reads back as the same double, in Python's notation; NULL for NaN.

    Any decimal of up to 15 digits survives a double, so the first of 15, 16 and 17 digits that reads
    back is the shortest once its zeros are cut. Only doubles below the normal range need all lengths.
    Above a power of two doubles lie wider apart than below it, so there the next 16 digits upwards
    may read back where the nearest ones do not. Where several texts of the shortest length read back,
    the last digit can differ from Python's (some ten in a million), as the JVM rounds a rounded text.
    """

    def upwards() -> Column:
        text = F.format_string("%.16e", F.abs(number))
        digits = (F.substring(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), 1, 16).try_cast("long") + 1).cast("string")
        sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
        moved = F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 15), F.lit("e"), F.substring_index(text, "e", -1))
        return F.when(F.length(digits) == 16, moved)

    def shortest(lengths: range) -> Column:
        texts = [F.format_string(f"%.{n - 1}e", number) for n in lengths]
        texts.insert(-1, upwards())
        return F.coalesce(*[F.when(text.try_cast("double") == number, text) for text in texts])

    def written(text: Column) -> Column:
        sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        digits = F.rtrim(F.replace(F.ltrim(F.substring_index(text, "e", 1), F.lit("-")), F.lit("."), F.lit("")), F.lit("0"))
        exponent = F.substring_index(text, "e", -1).try_cast("int")
        return F.transform(F.array(F.struct(sign.alias("sign"), digits.alias("digits"), exponent.alias("exponent"))), layout)[0]

    def layout(parts: Column) -> Column:
        digits, exponent = parts["digits"], parts["exponent"]
        size = F.length(digits)
        rest = F.substring(digits, F.lit(2), size)
        whole = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size))
        scientific = F.concat(
            F.substring(digits, F.lit(1), F.lit(1)),
            F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
            F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
        )
        plain = (
            F.when(size == 0, F.lit("0.0"))
            .when(~exponent.between(-4, 15), scientific)
            .when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
            .when(size <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0")))
            .otherwise(whole)
        )
        return F.concat(parts["sign"], plain)

    smallest_normal = 2.0**-1022
    text = F.when((F.abs(number) < smallest_normal) & (number != 0), shortest(range(1, 18))).otherwise(shortest(range(15, 18)))
    return (
        F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
        .when(F.abs(number) == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(written(text))
    )
