"""Column helpers with explicit rules for missing and infinite values: NULL is the only missing value, infinities stay."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clean(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def div(a: Column, b: Column) -> Column:
    """x/0 is an infinity with the sign of x; 0/0 is missing."""
    return clean(F.when(b != 0, F.try_divide(a, b)).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF)))


def ln(x: Column) -> Column:
    """ln(0) is -inf; ln of a negative number is missing."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF))


# Ln 2 in two parts, the first of which times an exponent is exact.
_LN2 = (6.93147180369123816490e-01, 1.90821492927058770002e-10)


def exact_ln(x: Column, let: Callable[[Column], Column]) -> Column:
    """:func:`ln` rounded to the nearest double, as C libraries round it; Java's may miss by one place.

    For orders by sums of logarithms, in which the last place decides.  x is 2**k z; ln z = 2 atanh((z - 1) / (z + 1)), the
    quotient with its remainder.  ``let`` names a step.
    """
    k = let(F.round(F.log2(x)))
    z = let(x / F.pow(F.lit(2.0), k))
    below, above = let(z - 1), let(z + 1)
    q = let(below / above)

    def halves(v: Column) -> tuple[Column, Column]:
        wide = let(v * F.lit(134217729.0))
        high = let(wide - (wide - v))
        return high, let(v - high)

    (qh, ql), (ah, al) = halves(q), halves(above)
    near = let(q * above)
    off = let(((qh * ah - near) + qh * al + ql * ah) + ql * al)
    rest = let((((below - near) - off) - q * (z - (above - 1))) / above)
    square = let(q * q)
    series = F.lit(1 / 25)
    for n in range(23, 1, -2):
        series = series * square + F.lit(1 / n)
    high, twice = let(k * F.lit(_LN2[0])), let(2 * q)
    total_ = let(high + twice)
    back = let(total_ - high)
    lost = (high - (total_ - back)) + (twice - back)
    value = total_ + (lost + (k * F.lit(_LN2[1]) + 2 * rest * (1 + square) + twice * square * series))
    return F.when((x > 1e-300) & (x < 1e300), value).otherwise(ln(x))


def log1p(x: Column) -> Column:
    return ln(x + F.lit(1.0))


def power(x: Column, p: Column | float) -> Column:
    return clean(F.pow(x, p))


def finite(x: Column) -> Column:
    """x where it is neither missing nor infinite."""
    return F.when(F.abs(x) < INF, x)


def total(xs: list[Column]) -> Column:
    return clean(reduce(lambda a, b: a + b, xs))


def product(xs: list[Column]) -> Column:
    return clean(reduce(lambda a, b: a * b, xs))


def holds(condition: Column) -> Column:
    """A condition that a missing value makes false."""
    return F.coalesce(condition, F.lit(False))


def keep_if(x: Column, condition: Column) -> Column:
    """Inclusion screen: missing conditions drop."""
    return F.when(condition, x)


def drop_if(x: Column, condition: Column) -> Column:
    """Exclusion screen: missing conditions keep."""
    return F.when(~holds(condition), x)


def indicator(condition: Column) -> Column:
    return condition.cast("double")


def number(code: Column) -> Column:
    """A code as a number, missing where it is none."""
    return code.try_cast("double")


def or_infinite(x: Column) -> Column:
    """Missing and infinite values count as +inf in comparisons."""
    return F.when(F.abs(x) < INF, x).otherwise(F.lit(INF))


def null_skipping_mean(xs: list[Column]) -> Column:
    filled = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    count = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return clean(F.when(count > 0, filled / count))


def null_skipping_stats(xs: list[Column]) -> tuple[Column, Column]:
    """Mean and two-pass sample standard deviation (missing below two values) over columns, missing ones skipped."""
    there = F.filter(F.array(*xs), lambda v: v.isNotNull())
    n = F.size(there)
    mean = F.when(n > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / n)
    squares = F.aggregate(F.transform(there, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    same = F.array_min(there) == F.array_max(there)
    return clean(mean), clean(F.when(n > 1, F.when(same, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1)))))
