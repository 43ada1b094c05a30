"""Universe masks and fill domains.

The spine carries booleans ``strict`` (a row of the common-share universe), ``listed`` (any monthly stock row),
``compustat`` (an annual-statement row) and ``linked`` (a strict row with a firm id); masks are conditions on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.ieee import keep_if
from cadenza.operators.registry import operator
from cadenza.plans.stage import Stage


def span(s: Stage, flag: Column) -> Column:
    """Months from an entity's first to its last flagged one."""
    whole = W.partitionBy("e")
    months = F.when(flag, F.col("m"))
    return s.let(F.col("m").between(F.min(months).over(whole), F.max(months).over(whole)), "span")


@operator
def smt_only(s: Stage, x: Column) -> Column:
    return keep_if(x, F.col("strict"))


@operator
def smt_fill(s: Stage, x: Column, value: float = 0.0) -> Column:
    return keep_if(F.coalesce(x, F.lit(float(value))), F.col("strict"))


@operator
def span_fill(s: Stage, x: Column, value: float = 0.0) -> Column:
    inside = span(s, F.col("strict"))
    return keep_if(F.coalesce(F.when(F.col("strict"), x), F.lit(float(value))), inside)


@operator
def span_only(s: Stage, x: Column) -> Column:
    return keep_if(x, span(s, F.col("strict")))


@operator
def crsp_only(s: Stage, x: Column) -> Column:
    return keep_if(x, F.col("listed"))


@operator
def smt_gvkey_only(s: Stage, x: Column) -> Column:
    return keep_if(x, F.col("linked"))


@operator
def compustat_rows_only(s: Stage, x: Column) -> Column:
    return keep_if(x, F.col("compustat"))


@operator
def compustat_span_fill(s: Stage, x: Column, value: float = 0.0) -> Column:
    return keep_if(F.coalesce(x, F.lit(float(value))), span(s, F.col("compustat")))


@operator
def firm_age(s: Stage, *x: Column, require_compustat_row: bool = False) -> Column:
    """Number of universe rows so far; missing where it equals the months since July 1926, by days over 30.44."""
    basis = F.col("strict") & F.col("compustat") if require_compustat_row else F.col("strict")
    age = s.let(F.sum(basis.cast("int")).over(s.until).cast("double"))
    month = F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1))
    since = F.rint(F.datediff(month, F.lit("1926-07-01").cast("date")) / F.lit(30.44)) + 1
    return F.when(basis & (age != since), age)
