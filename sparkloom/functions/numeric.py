"""Arithmetic: overflow and division by zero give NULL, integers divide to integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def add(a, b) -> Column:
    return F.try_add(_column(a), _column(b))


def subtract(a, b) -> Column:
    return F.try_subtract(_column(a), _column(b))


def multiply(a, b) -> Column:
    return F.try_multiply(_column(a), _column(b))


def divide(a, b) -> Column:
    """Floating division; NULL for a divisor of 0."""
    return F.try_divide(_column(a).cast("double"), _column(b).cast("double"))


def int_divide(a, b) -> Column:
    """Integer division that truncates toward zero; NULL for a divisor of 0 (and for the one overflow)."""
    a, b = _column(a).cast("long"), _column(b).cast("long")
    overflow = (b == -1) & (a == F.lit(-(2**63)))
    return F.call_function("div", F.when(~overflow, a), F.nullif(b, F.lit(0).cast("long")))


def modulo(a, b) -> Column:
    """Remainder with the sign of the dividend; NULL for a divisor of 0."""
    return F.try_mod(_column(a), _column(b))


def bit_and(a, b) -> Column:
    return _column(a).cast("long").bitwiseAND(_column(b).cast("long"))


def bit_or(a, b) -> Column:
    return _column(a).cast("long").bitwiseOR(_column(b).cast("long"))


def bit_xor(a, b) -> Column:
    return _column(a).cast("long").bitwiseXOR(_column(b).cast("long"))


def bit_not(a) -> Column:
    return F.bitwise_not(_column(a).cast("long"))


def sql_round(x, digits: int = 0) -> Column:
    """Rounds half away from zero and gives a double; negative digits count as 0."""
    return F.round(_column(x).cast("double"), max(0, digits))


def sign(x) -> Column:
    """-1, 0 or 1 as a long."""
    return F.signum(_column(x).cast("double")).cast("long")


def scalar_max(*values) -> Column:
    """The greatest of two or more values, NULLs aside."""
    return F.greatest(*map(_column, values))


def scalar_min(*values) -> Column:
    return F.least(*map(_column, values))


def random_int() -> Column:
    """A random 64-bit integer."""
    high, low = ((F.rand() * F.lit(2.0**32)).cast("long") for _ in range(2))
    return F.shiftleft(high, 32).bitwiseOR(low)
