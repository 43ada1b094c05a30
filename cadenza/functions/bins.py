"""Ranks, quantile bins and exact quantiles within groups of rows of a stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.ieee import finite
from cadenza.plans.stage import Stage

Key = Column | str


def _interior(n: int) -> Column:
    return F.array(*[F.lit(k / n) for k in range(1, n)])


def qcut_bin(s: Stage, x: Column, n: int, *keys: Key) -> Column:
    """Value bins by month and keys: edges are the distinct least value, interior linear quantiles and greatest value.

    Bins are numbered from 1; a month in which all values are equal has no bins.
    """
    part = s.across(*keys)
    inner = s.let(F.percentile(x, _interior(n)).over(part), "cuts")
    low, high = s.let(F.min(x).over(part), "low"), s.let(F.max(x).over(part), "high")
    below = F.filter(F.array_distinct(inner), lambda v: (v > low) & (v < high) & (v < x))
    return s.let(F.when(x.isNotNull() & (low < high), F.lit(1) + F.size(below)), "bin")


def fastxtile_bin(s: Stage, x: Column, n: int, *keys: Key) -> Column:
    """Bins by strict excess over linear quantiles, equal cut points counted each; infinities are missing.

    Fewer values than bins, or one distinct value: bin 1.  Two distinct values: bins 1 and n.
    """
    part = s.across(*keys)
    x = s.let(finite(x), "x")
    inner = s.let(F.percentile(x, _interior(n)).over(part), "cuts")
    low, high = s.let(F.min(x).over(part), "low"), s.let(F.max(x).over(part), "high")
    count = s.let(F.count(x).over(part), "n")
    inside = s.let(F.count(F.when((x > low) & (x < high), 1)).over(part), "inside")
    plain = F.lit(1) + F.size(F.filter(inner, lambda v: x > v))
    bin_ = F.when((count < n) | (low == high), F.lit(1)).when(inside == 0, F.when(x == low, F.lit(1)).otherwise(F.lit(n))).otherwise(plain)
    return s.let(F.when(x.isNotNull(), bin_), "bin")


def average_rank(x: Column, *keys: Key) -> Column:
    """Ascending rank from 1 among present values; ties share their average."""
    there = x.isNotNull()
    first = F.rank().over(W.partitionBy(*keys, there).orderBy(x))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, x))
    return F.when(there, first.cast("double") + (ties - 1).cast("double") / F.lit(2.0))


def percent_rank(x: Column, *keys: Key) -> Column:
    return average_rank(x, *keys) / F.count(x).over(W.partitionBy(*keys))


def nearest_quantile(ordered: Column, q: float) -> Column:
    """Element floor(q (n - 1) + 0.5) of an ascending array."""
    return F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1) + F.lit(0.5)).cast("int"))


def lower_quantile(ordered: Column, q: float) -> Column:
    return F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def ranked_quantile(ordered: Column, q: float) -> Column:
    """First element of an ascending array whose rank exceeds q n; midway to the one before where q n is whole."""
    n, p = F.size(ordered), F.lit(q) * F.size(ordered)
    whole = F.floor(p + F.lit(1e-12)).cast("int")
    exact = (F.abs(p - whole) < 1e-12) & (whole >= 1) & (whole < n)
    return F.when(exact, (F.get(ordered, whole - 1) + F.get(ordered, whole)) / 2).when(n > 0, F.get(ordered, F.least(whole, n - 1)))
