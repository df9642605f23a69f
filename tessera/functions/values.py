"""Dynamically typed scalars as Column expressions: numeric prefixes, numeric strings, comparison, text of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as blank around a number.
_BLANK = r"[ \t\n\x0B\f\r]*"
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PREFIX = rf"^{_BLANK}({_NUMBER})"
_WHOLE = rf"^{_BLANK}(?:{_NUMBER}|[+-](?i:inf|nan)){_BLANK}$"
_SPECIAL = rf"^{_BLANK}([+-])(?i:(inf)|(nan)){_BLANK}$"


def num(text: Column) -> Column:
    """The longest numeric prefix of a text as a double; 0 where there is none, and for null.

    Signed ``+inf``, ``-inf``, ``+nan`` and ``-nan`` count only when they stand alone.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    sign = F.regexp_extract(text, _SPECIAL, 1)
    special = F.when(F.regexp_extract(text, _SPECIAL, 2) == "", float("nan")).when(sign == "-", float("-inf")).otherwise(float("inf"))
    prefix = F.regexp_extract(text, _PREFIX, 1)
    return F.when(prefix != "", prefix.try_cast("double")).when(sign != "", special).otherwise(0.0)


def looks_numeric(text: Column) -> Column:
    """Whether a whole text, without blanks around it, is a number. Null doesn't look numeric."""
    return F.coalesce(text.rlike(_WHOLE), F.lit(False))


def text(number: Column, digits: int = 6, whole: bool = True) -> Column:
    """A number as text: whole numbers without a point, others to ``digits`` significant digits (%g); null is empty.

    Without ``whole``, whole numbers too have at most ``digits`` significant digits.

    Built from decimal arithmetic, so that it stays in generated code.
    """
    x = number.cast("double")
    plainly = ((F.abs(x) < 1e16) & (x == F.floor(x))) if whole else x == 0
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    # rounding can carry into the next power of ten
    scaled = F.format_number(F.abs(x) / F.pow(F.lit(10.0), exponent), digits - 1)
    carried = F.when(scaled.startswith("10"), exponent + 1).otherwise(exponent)
    mantissa = F.when(scaled.startswith("10"), F.lit("1")).otherwise(trimmed(scaled))
    sign = F.when(x < 0, "-").otherwise("")
    pad = F.lpad(F.abs(carried).cast("string"), 2, "0")
    pad = F.when(F.abs(carried) > 99, F.abs(carried).cast("string")).otherwise(pad)
    scientific = F.concat(sign, mantissa, F.lit("e"), F.when(carried < 0, "-").otherwise("+"), pad)
    plain = F.lit("")
    for e in range(-4, digits):
        fixed = F.format_string(f"%.{digits - 1 - e}f", x)
        plain = F.when(carried == e, trimmed(fixed)).otherwise(plain)
    return (
        F.when(x.isNull(), "")
        .when(F.isnan(x), "+nan")
        .when(x == float("inf"), "+inf")
        .when(x == float("-inf"), "-inf")
        .when(plainly, x.cast("decimal(20,0)").cast("string"))
        .when((carried < -4) | (carried >= digits), scientific)
        .otherwise(plain)
    )


def trimmed(decimal: Column) -> Column:
    """Digits without zeros at the end of the fraction, nor a bare point."""
    return F.regexp_replace(F.regexp_replace(decimal, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def truthy(value: Column, kind: str = "input") -> Column:
    """Truth by kind: ``number`` not 0; ``string`` not empty; ``input`` not 0 if it looks numeric, else not empty."""
    if kind == "number":
        return F.coalesce(value != 0, F.lit(False))
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    return F.when(looks_numeric(value), num(value) != 0).otherwise(F.coalesce(value != "", F.lit(False)))


def compare(
    left: Column, op: str, right: Column, left_kind: str = "input", right_kind: str = "input", ignore_case: bool = False
) -> Column:
    """Compare as numbers if both sides are numbers or input that looks numeric, else as texts by code point.

    The kinds are ``number``, ``string`` and ``input``. They are known when the plan is built, so that the
    check of how input looks is only made where it can matter. NaN equals nothing. Null is empty and 0.
    ``ignore_case`` folds texts.
    """
    ops = {
        "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    }

    def as_number(value: Column, kind: str) -> Column:
        return F.coalesce(value.cast("double"), F.lit(0.0)) if kind == "number" else num(value)

    def as_text(value: Column, kind: str) -> Column:
        return text(value) if kind == "number" else F.coalesce(value.cast("string"), F.lit(""))

    a, b = as_number(left, left_kind), as_number(right, right_kind)
    by_number = ops[op](a, b) & ~F.isnan(a) & ~F.isnan(b) if op != "!=" else ops[op](a, b) | F.isnan(a) | F.isnan(b)
    if left_kind == right_kind == "number":
        return by_number
    texts = [as_text(left, left_kind), as_text(right, right_kind)]
    by_text = ops[op](*(map(F.lower, texts) if ignore_case else texts))
    if "string" in (left_kind, right_kind):
        return by_text
    sides = [F.coalesce(v.isNull(), F.lit(False)) | looks_numeric(v) for v, k in ((left, left_kind), (right, right_kind)) if k == "input"]
    both = sides[0] if len(sides) == 1 else sides[0] & sides[1]
    return F.when(both, by_number).otherwise(by_text)


def kind_of(value: Column) -> Column:
    """The kind of an input field: strnum, string, or untyped for null."""
    return F.when(value.isNull(), "untyped").when(looks_numeric(value), "strnum").otherwise("string")
