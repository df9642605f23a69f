"""Text functions as Column expressions. Positions count characters from 1."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.regex import is_literal, java, ungrouped
from tessera.functions.values import num, text


def matches(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern is found. A pattern without special characters becomes ``contains``, which scans can use."""
    if is_literal(pattern) and not ignore_case:
        return F.coalesce(value.contains(pattern), F.lit(False))
    return F.coalesce(value.rlike(java(pattern, ignore_case)), F.lit(False))


def index(value: Column, part: Column | str, ignore_case: bool = False) -> Column:
    """Where ``part`` first stands, 0 if nowhere, 1 if it is empty."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.instr(F.lower(value), F.lower(part)) if ignore_case else F.instr(value, part)


def substr(value: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """From ``start``, cut to a whole number; a start below 1 counts as 1 and doesn't shorten the result."""
    start = F.greatest(_whole(start), F.lit(1))
    size = F.length(value) if length is None else F.greatest(_whole(length), F.lit(0))
    return F.substring(value, start, size)


def _whole(value: Column | float) -> Column:
    return F.lit(int(value)) if isinstance(value, int | float) else value.cast("int")


def pieces(value: Column, separator: str | None = None, ignore_case: bool = False) -> Column:
    """Array of the parts of a text. Without a separator, runs of space, tab and newline separate; empty has none.

    A separator of one character is literal, a longer one a pattern; an empty one gives characters. With
    ``ignore_case`` a separator of one letter is both its cases.
    """
    empty = F.array().cast("array<string>")
    if separator is None or separator == " ":
        value = F.regexp_replace(value, r"^[ \t\n]+|[ \t\n]+$", "")
        separator = r"[ \t\n]+"
    elif len(separator) == 1:
        separator = ("(?i)" if ignore_case else "") + re.escape(separator)
    elif separator:
        separator = java(separator, ignore_case)
    return F.when(F.coalesce(value, F.lit("")) == "", empty).otherwise(F.split(value, separator, -1))


def separators(value: Column, separator: str) -> Column:
    """Array of what matches the separator pattern between the pieces."""
    return F.regexp_extract_all(value, F.lit(java(separator)), F.lit(0))


def found(value: Column, pattern: str = r"[^[:space:]]+") -> Column:
    """Array of all matches of the pattern: the fields that are described by their content."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(java(pattern)), F.lit(0))


def match(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Struct of the first match: start (0 if none), length (-1 if none)."""
    whole = java(pattern, ignore_case)
    before = F.length(F.get(F.split(value, whole, 2), 0))
    size = F.length(F.regexp_extract(value, whole, 0))
    hit = F.coalesce(value.rlike(whole), F.lit(False))
    return F.struct(
        F.when(hit, F.coalesce(F.regexp_instr(value, F.lit(whole)), before + 1)).otherwise(0).alias("start"),
        F.when(hit, size).otherwise(-1).alias("length"),
    )


def group(value: Column, pattern: str, number: int) -> Column:
    """A group of the first match; empty if there is none."""
    return F.regexp_extract(value, java(pattern), number)


def _replacement(text: str, groups: bool, offset: int = 0) -> str:
    """``&`` is the match, ``\\&`` an ampersand; with ``groups``, ``\\1`` to ``\\9`` are groups."""
    out, i = [], 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        if c == "\\" and after in ("&", "\\"):
            out.append(after if after == "&" else r"\\")
            i += 2
        elif groups and c == "\\" and after.isdigit():
            out.append(f"${int(after) + offset}")
            i += 2
        else:
            out.append(f"${offset}" if c == "&" else "\\" + c if c in "\\$" else c)
            i += 1
    return "".join(out)


def gsub(value: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    """Replace every match; ``&`` stands for it."""
    if is_literal(pattern) and pattern and not ignore_case and not re.search(r"[\\&]", replacement):
        return F.replace(value, F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(value, java(pattern, ignore_case), _replacement(replacement, False))


def gsub_count(value: Column, pattern: str) -> Column:
    """How many replacements ``gsub`` makes."""
    return F.regexp_count(value, F.lit(java(pattern)))


def sub(value: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    """Replace the first match. ``&`` stands for it."""
    flags, body = _split(java(pattern, ignore_case))
    return F.regexp_replace(value, f"{flags}^(.*?)({body})", "$1" + _replacement(replacement, False, 2))


def _split(pattern: str) -> tuple[str, str]:
    """The flags that ``java`` puts in front, and the rest."""
    end = pattern.index(")") + 1
    return pattern[:end], pattern[end:]


def gensub(value: Column, pattern: str, replacement: str, how: str | int = "g", ignore_case: bool = False) -> Column:
    """Replace all matches (``g``) or the n-th; ``\\1`` to ``\\9`` are groups, ``&`` and ``\\0`` the match."""
    if isinstance(how, str):
        if how[:1] not in ("g", "G"):
            raise ValueError("how must begin with g, or be a number")
        return F.regexp_replace(value, java(pattern, ignore_case), _replacement(replacement, True))
    (flags, body), n = _split(java(pattern, ignore_case)), max(how, 1)
    before = f"{flags}^((?:.*?(?:{ungrouped(body)})){{{n - 1}}}.*?)({body})"
    return F.regexp_replace(value, before, "$1" + _replacement(replacement, True, 2))


def strtonum(value: Column) -> Column:
    """Like ``num``, with 0x hexadecimal and leading-0 octal."""
    value = F.trim(value)
    hexadecimal, octal = F.regexp_extract(value, "^0[xX]([0-9A-Fa-f]+)", 1), F.regexp_extract(value, "^0([0-7]+)$", 1)
    return (
        F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("double"))
        .when(octal != "", F.conv(octal, 8, 10).cast("double"))
        .otherwise(num(value))
    )


def ordinal(value: Column) -> Column:
    """Code point of the first character; 0 for an empty text."""
    return F.coalesce(F.conv(F.hex(F.encode(F.substring(value, 1, 1), "UTF-32")), 16, 10).cast("int"), F.lit(0))


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


_CONVERSION = re.compile(r"%(?:(\d+)\$)?([-+ #0']*)(\*|\d+)?(?:\.(\*|\d*))?([a-zA-Z%])")
_KNOWN = "diuxXofFeEgGcs"


def formatted(template: str, *values: Column | int) -> Column:
    """printf: %d, %i, %u, %x, %X, %o, %f, %e, %E, %g, %G, %c and %s with flags, width and precision; %% is a percent sign.

    ``*`` takes a width or precision from the values, as a Python integer; ``%2$s`` names a value. A quote
    groups thousands. Numbers for %d are cut to whole ones, and %u, %x and %o show negative ones as
    unsigned. %c takes a code point, or the first character of a text; %s shows doubles as print does.
    Fractions are rounded half up by their decimal text. Unknown letters stay as they are.
    """
    out, taken, at, end = [], [], 0, 0

    def next_value():
        nonlocal at
        at += 1
        if at > len(values):
            raise ValueError("not enough values for the format")
        return values[at - 1]

    for m in _CONVERSION.finditer(template):
        out.append(template[end : m.start()].replace("%", "%%"))
        end = m.end()
        number, flags, width, precision, kind = m.groups()
        if kind == "%" or kind not in _KNOWN:
            out.append("%%" if kind == "%" else m.group().replace("%", "%%"))
            continue
        if width == "*":
            size = next_value()
            width, flags = str(abs(size)), flags + ("-" if size < 0 else "")
        if precision == "*":
            precision = str(next_value())
        value = values[int(number) - 1] if number else next_value()
        spec, value = _conversion(F.lit(value), kind, flags, width or "", None if precision is None else int(precision or 0))
        out.append(spec)
        taken.append(value)
    out.append(template[end:].replace("%", "%%"))
    return F.format_string("".join(out), *taken)


def _conversion(value: Column, kind: str, flags: str, width: str, precision: int | None) -> tuple[str, Column]:
    """The directive and value that Spark's format_string needs."""
    left = "-" if "-" in flags else ""
    keep = "".join(f for f in dict.fromkeys(flags.replace("'", ",")) if f != "0" or (width and not left))
    if not width:
        keep = keep.replace("-", "")
    if kind in "diuxXo":
        whole = value.cast("double").cast("bigint")
        if kind in "xXo" and precision is None:
            return "%" + "".join(f for f in keep if f not in "+ ,") + width + kind, whole
        if kind in "di" and precision is None:
            return "%" + keep.replace("#", "") + width + "d", whole
        digits = F.abs(whole).cast("string") if kind in "di" else F.conv(whole.cast("string"), 10, {"u": 10, "o": 8}.get(kind, 16))
        digits = F.lower(digits) if kind == "x" else digits
        digits = F.when(F.length(digits) < (precision or 0), F.lpad(digits, precision or 0, "0")).otherwise(digits)
        plus = "+" if "+" in flags else " " if " " in flags else ""
        sign = F.when(whole < 0, "-").otherwise(plus) if kind in "di" else F.lit("")
        return f"%{left if width else ''}{width}s", F.concat(sign, digits)
    if kind in "feEF":
        places = "" if precision is None else f".{precision}"
        return "%" + (keep if kind in "fF" else keep.replace(",", "")) + width + places + kind.replace("F", "f"), value.cast("double")
    if kind in "gG":
        x = value.cast("double")
        shown = text(x, 6 if precision is None else max(precision, 1), whole=False)
        shown = F.when((x >= 0) & F.lit("+" in flags), F.concat(F.lit("+"), shown)).otherwise(shown)
        return f"%{left if width else ''}{width}s", F.upper(shown) if kind == "G" else shown
    is_text, is_fraction = F.typeof(value) == "string", F.typeof(value).isin("double", "float")
    if kind == "c":
        shown = F.when(is_text, F.substring(value.cast("string"), 1, 1)).otherwise(character(value.try_cast("bigint")))
    else:
        shown = F.when(is_fraction, text(value.try_cast("double"))).otherwise(value.cast("string"))
        shown = F.coalesce(shown, F.lit(""))
    cut = "" if precision is None or kind == "c" else f".{precision}"
    return f"%{left if width else ''}{width}{cut}s", shown


def match_groups(value: Column, pattern: str, groups: int) -> Column:
    """Array of the first match and its groups 1 to ``groups``; empty where there is no match."""
    whole = java(pattern)
    texts = F.array(*[F.regexp_extract(value, whole, i) for i in range(groups + 1)])
    return F.when(F.coalesce(value.rlike(whole), F.lit(False)), texts).otherwise(F.array().cast("array<string>"))


def between_found(value: Column, pattern: str = r"[^[:space:]]+") -> Column:
    """Array of what stands between the matches of the pattern, without what is before the first and after the last."""
    parts = F.split(F.coalesce(value, F.lit("")), java(pattern), -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def match_offsets(value: Column, pattern: str, groups: int, ignore_case: bool = False) -> Column:
    """Array of (start, length) of the first match and its groups 1 to ``groups``; 0 and -1 where there is none.

    Spark has no function for where a group stands, so that batches of texts go through a pandas function.
    """
    import regex

    found = regex.compile(java(pattern, ignore_case).replace(r"\z", r"\Z"))

    @F.pandas_udf("array<struct<start:int,length:int>>")
    def offsets(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[tuple[int, int]]:
            m = found.search(text or "")
            spans = [m.span(i) for i in range(groups + 1)] if m else [(-1, -1)] * (groups + 1)
            return [(a + 1, b - a) if a >= 0 else (0, -1) for a, b in spans]

        return texts.map(one, na_action=None)

    return offsets(value)


def byte_length(value: Column) -> Column:
    """Length in bytes, as all text functions count in bytes mode."""
    return F.octet_length(value)


def byte_index(value: Column, part: str) -> Column:
    """Byte where ``part`` first stands, from 1; 0 if nowhere."""
    at = F.instr(value, part)
    return F.when(at > 0, F.octet_length(F.substring(value, F.lit(1), at - 1)) + 1).otherwise(0)


def byte_substr(value: Column, start: int, length: int | None = None) -> Column:
    """Like ``substr``, by bytes; a character that is cut becomes a replacement character."""
    raw = F.encode(value, "UTF-8")
    size = F.octet_length(raw) if length is None else F.lit(max(length, 0))
    # try: a part of a character is no text
    part = F.substring(raw, F.lit(max(start, 1)), size)
    return F.coalesce(F.try_validate_utf8(part.cast("string")), F.make_valid_utf8(part.cast("string")))
