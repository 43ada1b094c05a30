"""Operators on the values of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.functions.ieee import clean, drop_if, holds, indicator, keep_if, number
from cadenza.operators.registry import operator
from cadenza.plans.stage import Stage


def year_of(m: Column | str = "m") -> Column:
    return F.floor(F.col(m) / 12).cast("int") if isinstance(m, str) else F.floor(m / 12).cast("int")


def month_of(m: str = "m") -> Column:
    return F.col(m) % 12 + 1


@operator
def add(s: Stage, *xs: Column) -> Column:
    return ieee.total(list(xs))


@operator
def sub(s: Stage, a: Column, b: Column) -> Column:
    return clean(a - b)


@operator
def mul(s: Stage, *xs: Column) -> Column:
    return ieee.product(list(xs))


@operator
def div(s: Stage, a: Column, b: Column) -> Column:
    return ieee.div(a, b)


@operator
def log(s: Stage, x: Column) -> Column:
    return ieee.ln(x)


@operator
def pow_(s: Stage, x: Column, power: float) -> Column:
    return ieee.power(x, F.lit(float(power)))


@operator
def abs_(s: Stage, x: Column) -> Column:
    return F.abs(x)


@operator
def max_(s: Stage, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


@operator
def fillna(s: Stage, x: Column, other: Column | None = None, value: float | None = None) -> Column:
    return F.coalesce(x, other if other is not None else F.lit(float(value)))


@operator
def coalesce(s: Stage, *xs: Column) -> Column:
    return F.coalesce(*xs)


@operator
def positive_only(s: Stage, x: Column) -> Column:
    return keep_if(x, x > 0)


@operator
def negative_to_null(s: Stage, x: Column) -> Column:
    return keep_if(x, x >= 0)


@operator
def zero_to_null(s: Stage, x: Column) -> Column:
    return keep_if(x, x != 0)


@operator
def nonzero(s: Stage, x: Column) -> Column:
    return keep_if(x, x != 0)


@operator
def positive_indicator(s: Stage, x: Column) -> Column:
    return indicator(x > 0)


@operator
def abs_cap_to_null(s: Stage, x: Column, max_abs: float = 1.0) -> Column:
    return keep_if(x, F.abs(x) <= max_abs)


@operator
def threshold_min(s: Stage, x: Column, gate: Column, min_value: float) -> Column:
    return keep_if(x, gate >= min_value)


@operator
def year_filtered(s: Stage, x: Column, min_year: int | None = None, max_year: int | None = None) -> Column:
    return keep_if(x, (year_of() >= (min_year or 0)) & (year_of() <= (max_year or 9999)))


@operator
def nonfinancial_only(s: Stage, x: Column, sic: Column) -> Column:
    sic = number(sic)
    return keep_if(x, (sic < 6000) | (sic >= 7000))


@operator
def manufacturing_only(s: Stage, x: Column, sic: Column) -> Column:
    return keep_if(x, number(sic).between(2000, 3999))


@operator
def financial_excluded(s: Stage, x: Column, sic: Column) -> Column:
    sic = number(sic)
    return drop_if(x, (sic >= 6000) & (sic < 7000))


@operator
def shrcd_le11(s: Stage, x: Column, shrcd: Column) -> Column:
    return drop_if(x, number(shrcd) > 11)


@operator
def bm_defined_gate(s: Stage, x: Column, ceq: Column, mve: Column) -> Column:
    return keep_if(x, ieee.ln(ieee.div(ceq, mve)).isNotNull())


@operator
def deldrc_sample_filter(s: Stage, x: Column, drc: Column, ceq: Column, sale: Column, sic: Column) -> Column:
    sic = number(sic)
    out = holds(ceq <= 0) | (holds(drc == 0) & holds(x == 0)) | holds(sale < 5) | holds((sic >= 6000) & (sic < 7000))
    return F.when(~out, x)


@operator
def convertible_debt_indicator(s: Stage, dc: Column, cshrc: Column) -> Column:
    return F.when(dc.isNotNull() | cshrc.isNotNull(), indicator(holds(dc != 0) | holds(cshrc != 0)))


@operator
def enterprise_multiple(s: Stage, mve: Column, dltt: Column, dlc: Column, dc: Column, che: Column, oibdp: Column, ceq: Column) -> Column:
    return drop_if(ieee.div(mve + dltt + dlc + dc - che, oibdp), holds(ceq < 0) | holds(oibdp < 0))


@operator
def piecewise_tax_ratio(s: Stage, txfo: Column, txfed: Column, txt: Column, txdi: Column, ib: Column) -> Column:
    """Taxes over income at the statutory rate of the year, with four cases that count as 1."""
    # First years of the statutory rates.
    year = year_of()
    rate = F.when(year >= 1993, 0.35).when(year >= 1988, 0.34).when(year >= 1987, 0.40).when(year >= 1979, 0.46).otherwise(0.48)
    plain = ieee.div(ieee.div(F.when(txfo.isNull() | txfed.isNull(), txt - txdi).otherwise(txfo + txfed), rate), ib)
    domestic = holds(txt != 0) | holds(txdi != 0)
    undefined = holds(ib == 0) & (holds(txfo != 0) | holds(txfed != 0) | domestic)
    current = F.when(txfed.isNull(), holds(txfo > 0)).otherwise(holds(txfo + txfed > 0))
    owed = current | holds(txt > txdi) | (txfo.isNull() & txfed.isNull() & domestic)
    one = undefined | (holds(ib <= 0) & (owed | plain.isNull()))
    return ieee.finite(F.when(one, F.lit(1.0)).otherwise(plain))


@operator
def surprise_rd_indicator(s: Stage, xrd: Column, revt: Column, at: Column) -> Column:
    """1 if spending is positive and both it and its share of sales and of assets grew by more than five per cent."""
    before = s.lag(xrd, 12)
    share, asset = s.let(ieee.div(xrd, revt)), s.let(ieee.div(xrd, at))
    up = holds(share > 0) & holds(asset > 0) & holds(ieee.div(xrd, before) > 1.05) & holds(ieee.div(asset, s.lag(asset, 12)) > 1.05)
    return F.when(xrd.isNotNull() & before.isNotNull(), indicator(up))
