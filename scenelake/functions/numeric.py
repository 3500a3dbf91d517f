"""Rounding, modulo and quantisation with the array-library conventions the operators follow.

Halves go to the even neighbour, modulo takes the sign of the divisor, integer division floors and 8-bit casts
truncate. Spark's own `round`, `%` and `div` differ in each of these, so operators use only the helpers below.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def rint_i(x) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(_c(x)).cast("int")


def floor_div(a, b) -> Column:
    return F.floor(_c(a) / _c(b)).cast("int")


def wrap01(x) -> Column:
    """Fractional part that stays in [0, 1) for negative input."""
    return F.pmod(_c(x).cast("double"), F.lit(1.0))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def guard(x, eps: float) -> Column:
    """A divisor that cannot be smaller than eps."""
    return F.greatest(_c(x), F.lit(eps))


def u8_trunc(x) -> Column:
    """[0, 1] to 0..255 by truncation."""
    return (clip(x, 0.0, 1.0) * 255).cast("int")


def u8_round(x, white: float = 1.0) -> Column:
    """[0, white] to 0..255 with the half added first."""
    return clip(_c(x) * (255.0 / white) + 0.5, 0.0, 255.0).cast("int")


def r6(x) -> Column:
    """Six decimals without a negative zero, for comparing float results across engines."""
    return F.round(_c(x), 6) + F.lit(0.0)
