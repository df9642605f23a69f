"""Numeric and bit functions as Column expressions. Numbers are doubles; bit functions cut them to 64-bit integers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(x: Column) -> Column:
    """Cut toward 0."""
    x = x.cast("double")
    return F.when(F.abs(x) >= 2**53, x).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def log(x: Column) -> Column:
    """Natural logarithm: NaN below 0, -inf at 0."""
    x = x.cast("double")
    return F.when(x < 0, float("nan")).when(x == 0, float("-inf")).otherwise(F.ln(x))


def intdiv(a: Column, b: Column) -> Column:
    """Whole quotient toward 0; a zero divisor is an error."""
    return F.call_function("div", _whole(a), _whole(b))


def intdiv0(a: Column, b: Column) -> Column:
    """Whole quotient toward 0; 0 for a zero divisor."""
    return F.when(_whole(b) == 0, F.lit(0).cast("bigint")).otherwise(intdiv(a, F.when(_whole(b) != 0, b)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; a zero divisor is an error."""
    return a.cast("double") % b.cast("double")


def truth(x: Column) -> Column:
    """1 if true, else 0."""
    return F.when(x, 1).otherwise(0)


def _whole(x: Column) -> Column:
    return x.cast("double").cast("bigint")


def _not_negative(x: Column) -> Column:
    return F.when(_whole(x) < 0, F.raise_error(F.lit("negative value in a bit function")).cast("bigint")).otherwise(_whole(x))


def bit_and(*values: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), map(_whole, values))


def bit_or(*values: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), map(_whole, values))


def bit_xor(*values: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), map(_whole, values))


def shift_left(x: Column, by: int) -> Column:
    """Shift by ``by`` mod 64 bits; a negative value is an error."""
    return F.shiftleft(_not_negative(x), by % 64)


def shift_right(x: Column, by: int) -> Column:
    """Shift by ``by`` mod 64 bits, filling with 0; a negative value is an error."""
    return F.shiftrightunsigned(_not_negative(x), by % 64)


def complement(x: Column) -> Column:
    return F.bitwise_not(_not_negative(x))


#: The multiplier, increment and seed of the random sequence, of which bits 16 to 30 are used.
MULTIPLIER, INCREMENT, SEED = 1103515245, 12345, 1


def random_at(number: Column, seed: int = SEED, bits: int = 48) -> Column:
    """The ``number``-th value, from 1, of the random sequence that begins with ``seed``: from 0 to below 1.

    Any value is found at once, by the powers of the step for each bit of its number, so that records need no order.
    """
    mask, a, c, steps = (1 << 31) - 1, MULTIPLIER & ((1 << 31) - 1), INCREMENT, []
    for k in range(bits):
        steps.append(F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c")))
        a, c = a * a & mask, (a * c + c) & mask
    has = lambda s: F.call_function("shiftright", number.cast("bigint"), s["k"]).bitwiseAND(F.lit(1)) == 1
    step = lambda x, s: F.when(has(s), (x * s["a"] + s["c"]).bitwiseAND(F.lit(mask))).otherwise(x)
    return F.aggregate(F.array(*steps), F.lit(seed & mask).cast("bigint"), step, lambda x: F.shiftright(x, 16) / 32768.0)


def exact(value: Column, scale: int = 0) -> Column:
    """A number of up to 38 digits, ``scale`` of them after the point; null if it is none or too large."""
    return value.try_cast(f"decimal(38,{scale})")
