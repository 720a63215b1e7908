"""Signed 8-bit fixed-point numbers in (-1, 1): raw r stands for r / 128; arithmetic saturates.

Raw values compare as the numbers do (``<``, ``=`` and so on of the columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, NAN = 127, -128
#: Raw values of the constants, and the step between numbers.
ZERO, ONE, TYPEMAX, TYPEMIN, EPS = 0, MOST, MOST, -MOST, 1.0 / 128.0


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x)).cast("int")


def encode(x: Column) -> Column:
    return _clamp(F.rint(x * F.lit(128.0)))


def decode(r: Column) -> Column:
    return r / F.lit(128.0)


def add(a: Column, b: Column) -> Column:
    return _clamp(a + b)


def subtract(a: Column, b: Column) -> Column:
    return _clamp(a - b)


def negate(a: Column) -> Column:
    return _clamp(-a.cast("int"))


def absolute(a: Column) -> Column:
    return _clamp(F.abs(a.cast("int")))


def sign(a: Column) -> Column:
    """The largest value, the least one or 0."""
    return (F.signum(a) * F.lit(MOST)).cast("int")


def less(a: Column, b: Column) -> Column:
    return a < b


def equal(a: Column, b: Column) -> Column:
    return a == b


def is_nan(a: Column) -> Column:
    return a == F.lit(NAN)


def promote(r: Column, kind: str = "double") -> Column:
    """As a floating number of another kind (``float`` or ``double``)."""
    return decode(r).cast(kind)


def random(u: Column) -> Column:
    """A raw value from a uniform number in [0, 1): each of -127 to 127 as likely."""
    return (F.floor(u * F.lit(float(2 * MOST + 1))) - MOST).cast("int")


def multiply(a: Column, b: Column) -> Column:
    return _clamp(F.shiftright((a * b).cast("int"), 7))


def divide(a: Column, b: Column) -> Column:
    """Truncating; by zero the largest value with the sign of a."""
    exact = F.shiftleft(a.cast("int"), 7) / F.nullif(b, F.lit(0))
    q = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
    return F.when(b == 0, F.when(a < 0, -MOST).otherwise(MOST)).otherwise(_clamp(q))
