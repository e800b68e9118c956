"""Integer and float arithmetic of scripts as column functions.

Integers are 64-bit and wrap around; division and remainder follow the divisor's
sign; shifts are logical and may go either way. A null operand, and an integer
division by zero, give null. Nothing here raises, whatever the ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 64
_LEAST = -(1 << 63)


def _wide(c: Column) -> Column:
    return c.cast("long").cast("decimal(19,0)")


def _wrapped(value: Column) -> Column:
    """The number modulo 2**64, as a signed 64-bit number."""
    wide = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    # One chain, so that nothing in it is evaluated twice: above -2**64, then above 0, then below 2**64.
    rest = value.cast("decimal(38,0)") % wide(_WORD)
    return ((rest + wide(_WORD - _LEAST)) % wide(_WORD) + wide(_LEAST)).cast("long")


def polynomial(start: Column, *steps: tuple[int, int]) -> Column:
    """start times a number plus a number, step by step, wrapped around once at the end; numbers of 38 digits at most on the way."""
    value = _wide(start)
    for factor, plus in steps:
        value = value * F.lit(str(factor)).cast(f"decimal({len(str(abs(factor)))},0)") + F.lit(str(plus)).cast(f"decimal({len(str(abs(plus)))},0)")
    return _wrapped(value)


def add(a: Column, b: Column) -> Column:
    return _wrapped(_wide(a) + _wide(b))


def subtract(a: Column, b: Column) -> Column:
    return _wrapped(_wide(a) - _wide(b))


def multiply(a: Column, b: Column) -> Column:
    return _wrapped(_wide(a) * _wide(b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    rest = F.when((b != 0) & (b != -1), a % F.when(b != 0, b)).when((b == -1) & a.isNotNull(), F.lit(0))
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest).cast("long")


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down; the least number by -1 is the least number again."""
    safe = F.when((b != 0) & ~((a == _LEAST) & (b == -1)), b)
    whole = F.call_function("div", a.cast("long"), safe.cast("long"))
    down = F.when((a - whole * safe != 0) & ((a < 0) != (b < 0)), whole - 1).otherwise(whole)
    return F.when((a == _LEAST) & (b == -1), a).otherwise(down).cast("long")


def float_mod(a: Column, b: Column) -> Column:
    """a - floor(a / b) * b of doubles; not a number where b is 0. Quotients from 2**53 on are whole as they are."""
    ratio = a / F.when(b != 0, b)
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a - F.when(F.abs(ratio) >= 2.0**53, ratio).otherwise(F.floor(ratio).cast("double")) * b)


def shift_left(a: Column, by: Column) -> Column:
    """A shift by 64 or more gives 0; a negative one goes right, without the sign."""
    n = F.when(F.abs(F.greatest(by, F.lit(-64))) <= 64, by).cast("int")
    moved = F.when(by >= 0, F.call_function("shiftleft", a, n)).otherwise(F.call_function("shiftrightunsigned", a, -n))
    return F.when(((by <= -64) | (by >= 64)) & a.isNotNull(), F.lit(0)).otherwise(moved).cast("long")


def shift_right(a: Column, by: Column) -> Column:
    n = F.when(F.abs(F.greatest(by, F.lit(-64))) <= 64, by).cast("int")
    moved = F.when(by >= 0, F.call_function("shiftrightunsigned", a, n)).otherwise(F.call_function("shiftleft", a, -n))
    return F.when(((by <= -64) | (by >= 64)) & a.isNotNull(), F.lit(0)).otherwise(moved).cast("long")


def _known(a: Column, b: Column) -> Column:
    return ~(F.isnan(a) | F.isnan(b))


def less(a: Column, b: Column) -> Column:
    """a < b of doubles; false where either is not a number, which Spark sorts last and takes for equal to itself."""
    return _known(a, b) & (a < b)


def less_equal(a: Column, b: Column) -> Column:
    return _known(a, b) & (a <= b)


def equal(a: Column, b: Column) -> Column:
    return _known(a, b) & (a == b)
