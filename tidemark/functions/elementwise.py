"""Element-wise operators on double columns, with IEEE results where Spark would raise or give NULL.

NULL is a missing cell, NaN an undefined number. Arithmetic keeps both. Comparisons, logic, ``where``, ``minimum`` and
``maximum`` turn a NULL operand into NaN. A comparison with NaN is 0.0; truth is 1.0 or 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def nan() -> Column:
    return F.lit(float("nan"))


def inf(sign: int = 1) -> Column:
    return F.lit(float("inf") * sign)


def known(x: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(x), x)


def n0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    """x/0 is an infinity with the sign of x, 0/0 NaN; NULL stays NULL."""
    zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).when(a < 0, inf(-1))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero)


def neg(x: Column) -> Column:
    return -x


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    """-1, 0 or 1; NaN gives 0."""
    return F.when(x.isNull(), None).when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def log(x: Column) -> Column:
    """Natural logarithm; 0 gives -inf, negatives NaN."""
    return F.when(x > 0, F.log(x)).when(x == 0, inf(-1)).when(x < 0, nan())


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, inf(-1)).when(x < 0, nan())


def exp(x: Column) -> Column:
    return F.exp(x)


def power(x: Column, exponent: float = 2.0) -> Column:
    return F.pow(x, F.lit(exponent))


def clip(x: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    """NaN gives the lower bound."""
    return F.when(F.isnan(x), F.lit(low)).when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_half_away(x: Column, decimals: int = 0) -> Column:
    scale = F.lit(10.0**decimals)
    return sign(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def modulo(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_mod(a, b)).when(b == 0, nan())


def _picked(a: Column, b: Column, best) -> Column:
    return F.when(a.isNull() | b.isNull(), nan()).when(F.isnan(a), b).when(F.isnan(b), a).otherwise(best(a, b))


def minimum(a: Column, b: Column) -> Column:
    """A NULL gives NaN; of one NaN and a number, the number."""
    return _picked(a, b, F.least)


def maximum(a: Column, b: Column) -> Column:
    return _picked(a, b, F.greatest)


def _truth(a: Column, b: Column, test: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), nan()).when(F.isnan(a) | F.isnan(b), 0.0).otherwise(test.cast("double"))


def gt(a: Column, b: Column) -> Column:
    return _truth(a, b, a > b)


def lt(a: Column, b: Column) -> Column:
    return _truth(a, b, a < b)


def ge(a: Column, b: Column) -> Column:
    return _truth(a, b, a >= b)


def le(a: Column, b: Column) -> Column:
    return _truth(a, b, a <= b)


def eq(a: Column, b: Column) -> Column:
    """Within 1e-10."""
    return _truth(a, b, F.abs(a - b) < EPSILON)


def ne(a: Column, b: Column) -> Column:
    return _truth(a, b, F.abs(a - b) >= EPSILON)


def both(a: Column, b: Column) -> Column:
    """Non-zero is true, NaN too."""
    return F.when(a.isNull() | b.isNull(), nan()).otherwise(((a != 0) & (b != 0)).cast("double"))


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), nan()).otherwise(((a != 0) | (b != 0)).cast("double"))


def negation(x: Column) -> Column:
    return (x == 0).cast("double")


def where(condition: Column, x: Column, y: Column) -> Column:
    """x where the condition is not zero, else y; a NULL anywhere gives NaN."""
    return F.when(condition.isNull() | x.isNull() | y.isNull(), nan()).when(condition != 0, x).otherwise(y)


def is_nan(x: Column) -> Column:
    return F.when(x.isNotNull(), F.isnan(x).cast("double"))


def fill_nan(x: Column, value: float = 0.0) -> Column:
    """Replaces NaN, not NULL."""
    return F.nanvl(x, F.lit(value))


def first_known(a: Column, b: Column) -> Column:
    return F.coalesce(known(a), b, nan())
