"""Operators along the months of one entity.

All windows are partitioned by entity and ordered by the month number, with calendar ranges; so however many of them a
plan has, rows are shuffled by entity once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.functions.ieee import clean, finite, holds, indicator, keep_if
from cadenza.operators.elementwise import month_of, year_of
from cadenza.operators.registry import operator
from cadenza.plans.stage import Stage


@operator
def lag(s: Stage, x: Column, n: int) -> Column:
    return s.lag(x, int(n))


@operator
def time_lagged_value(s: Stage, x: Column, months: int) -> Column:
    return s.lag(x, int(months))


@operator
def delta(s: Stage, x: Column, n: int) -> Column:
    return clean(s.delta(x, int(n)))


def _runs(lags: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive lags, as (least, greatest)."""
    out: list[list[int]] = []
    for k in sorted(lags):
        if out and k == out[-1][1] + 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return [(a, b) for a, b in out]


@operator
def mean_of_lags(s: Stage, x: Column, lags: list[int], fill_missing: float | None = None) -> Column:
    """Mean of the present values among the lags: one range frame for each run of consecutive lags."""
    if fill_missing is not None:
        x = s.let(F.coalesce(x, F.lit(float(fill_missing))))
    sums, counts = [], []
    for a, b in _runs(lags):
        frame = s.months(-b, -a)
        sums.append(s.let(F.coalesce(F.sum(x).over(frame), F.lit(0.0))))
        counts.append(s.let(F.count(x).over(frame)))
    n = reduce(lambda a, b: a + b, counts)
    return clean(F.when(n > 0, reduce(lambda a, b: a + b, sums) / n))


@operator
def compound_return(s: Stage, x: Column, lags: list[int], fill_missing: float | None = None) -> Column:
    """Product of 1 + x over the lags, less 1; every lag has to be present, so months before the first row count as missing."""
    if fill_missing is not None:
        x = s.let(F.coalesce(x, F.lit(float(fill_missing))))
    grown = s.let(1 + x)
    parts, counts = [], []
    for a, b in _runs(lags):
        frame = s.months(-b, -a)
        parts.append(s.let(F.product(grown).over(frame)))
        counts.append(s.let(F.count(x).over(frame)))
    whole = reduce(lambda a, b: a + b, counts) == len(set(lags))
    return F.when(whole, clean(reduce(lambda a, b: a * b, parts) - 1))


@operator
def require_any_lag(s: Stage, x: Column, source: Column, lags: list[int]) -> Column:
    """x where the source was present, on a row of the strict universe, at one of the lags."""
    seen = s.let(F.when(F.col("strict"), source))
    counts = [s.let(F.count(seen).over(s.months(-b, -a))) for a, b in _runs(lags)]
    return keep_if(x, reduce(lambda a, b: a + b, counts) > 0)


@operator
def ffill(s: Stage, x: Column) -> Column:
    return s.let(F.last(x, ignorenulls=True).over(s.until))


@operator
def rolling_mean(s: Stage, x: Column, window_months: int, min_obs: int | None = None) -> Column:
    least = window_months // 2 if min_obs is None else min_obs
    frame = s.months(-(window_months - 1), 0)
    return s.let(clean(F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))))


@operator
def rolling_std(s: Stage, x: Column, window_months: int, min_obs: int | None = None) -> Column:
    least = window_months // 2 if min_obs is None else min_obs
    frame = s.months(-(window_months - 1), 0)
    # Equal values have deviation 0, whatever rounding does to their mean.
    flat = s.let(F.min(x).over(frame) == F.max(x).over(frame))
    # In two passes: an update row by row is off by a place more often, which shows where a value lies at a tie.
    n, mean, there = s.let(F.count(x).over(frame)), s.let(F.avg(x).over(frame)), s.let(F.collect_list(x).over(frame))
    squares = F.aggregate(there, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return s.let(clean(F.when(n >= max(2, least), F.when(flat, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1))))))


@operator
def rolling_trend_slope_scaled(s: Stage, x: Column, window_months: int, min_obs: int = 30) -> Column:
    """Slope over the last ``window_months`` present values, carried forward, over the calendar window's mean."""
    there = s.df.select("e", "m", x.alias("x")).where("x IS NOT NULL")
    valid = W.partitionBy("e").orderBy("m").rowsBetween(-(window_months - 1), 0)
    slope = clean(F.when(F.count("x").over(valid) >= min_obs, F.regr_slope("x", F.col("m").cast("double")).over(valid)))
    coefficient = s.attach(there.select("e", "m", slope.alias("value")))
    carried = s.let(F.last(coefficient, ignorenulls=True).over(s.until))
    frame = s.months(-(window_months - 1), 0)
    mean = s.let(F.when(F.count(x).over(frame) >= min_obs, F.avg(x).over(frame)))
    return ieee.div(carried, F.nullif(mean, F.lit(0.0)))


@operator
def investment_to_sales_scaled(s: Stage, capx: Column, revt: Column, window_months: int = 36, min_obs: int = 24) -> Column:
    ratio = s.let(ieee.div(capx, revt))
    frame = s.months(-(window_months - 1), 0)
    mean = s.let(clean(F.when(F.count(ratio).over(frame) >= min_obs, F.avg(ratio).over(frame))))
    return keep_if(ieee.div(ratio, mean), revt >= 10)


@operator
def exchange_switch_indicator(s: Stage, x: Column, lookback_months: int = 12) -> Column:
    """1 for a move, within the look-back, from code 2 or 3 to 1 or from code 3 to 2."""
    frame = s.months(-lookback_months, -1)
    two_or_three = s.let(F.coalesce(F.max(x.isin(2, 3).cast("int")).over(frame), F.lit(0)))
    three = s.let(F.coalesce(F.max((x == 3).cast("int")).over(frame), F.lit(0)))
    return F.when(x.isNotNull(), indicator((holds(x == 1) & (two_or_three == 1)) | (holds(x == 2) & (three == 1))))


@operator
def market_equity_matched_to_datadate(s: Stage, x: Column, datadate: Column, lag_months: int = 6) -> Column:
    """Value of ``lag_months`` ago where that is the statement's month, carried forward; datadate is a month number."""
    matched = s.let(F.when(datadate == F.col("m") - lag_months, s.lag(x, lag_months)))
    return s.let(F.last(matched, ignorenulls=True).over(s.until))


@operator
def gr_ltnoa(s: Stage, rect: Column, invt: Column, ppent: Column, aco: Column, intan: Column, ao: Column, ap: Column, lco: Column, lo: Column, at: Column, dp: Column) -> Column:
    """Growth of net operating assets over average assets, less the growth of working capital, depreciation added back."""
    mean_at = s.let((at + s.lag(at, 12)) / 2)
    level = s.let(ieee.div(rect + invt + ppent + aco + intan + ao - ap - lco - lo, at))
    working = s.delta(rect, 12) + s.delta(invt, 12) + s.delta(aco, 12) - (s.delta(ap, 12) + s.delta(lco, 12)) - dp
    return clean(s.delta(level, 12) - ieee.div(working, mean_at))


@operator
def earnings_consistency(s: Stage, epspx: Column) -> Column:
    e12, e24 = s.lag(epspx, 12), s.lag(epspx, 24)
    growth = s.let(finite(ieee.div(epspx - e12, F.lit(0.5) * (F.abs(e12) + F.abs(e24)))))
    mean = ieee.null_skipping_mean([growth, *(s.lag(growth, k) for k in (12, 24, 36, 48))])
    before = s.lag(growth, 12)
    turned = (holds(growth > 0) & holds(before < 0)) | (holds(growth < 0) & (holds(before > 0) | before.isNull()))
    out = epspx.isNull() | e12.isNull() | holds(F.abs(ieee.div(epspx, e12)) > 6) | turned
    return F.when(~out, mean)


@operator
def seasonal_surprise_zscore(s: Stage, x: Column, min_sd: float | None = None) -> Column:
    quarters = range(3, 25, 3)
    growth = s.let(x - s.lag(x, 12))
    drift, _ = ieee.null_skipping_stats([s.lag(growth, k) for k in quarters])
    surprise = s.let(clean(growth - drift))
    _, sd = ieee.null_skipping_stats([s.lag(surprise, k) for k in quarters])
    sd = s.let(sd)
    enough = sd > 1e-10 if min_sd is None else sd >= min_sd
    return finite(F.when(enough, surprise / sd))


@operator
def total_accruals_signal(s: Stage, ivao: Column, ivst: Column, dltt: Column, dlc: Column, pstk: Column, sstk: Column, prstkc: Column, dv: Column, act: Column, che: Column, lct: Column, at: Column, lt: Column, ni: Column, oancf: Column, ivncf: Column, fincf: Column) -> Column:
    """Changes of working, non-current and financial capital through 1989, cash-flow accruals after, over lagged assets."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    working = s.let((act - che) - (lct - zero(dlc)))
    fixed = s.let((at - act - zero(ivao)) - (lt - zero(dlc) - zero(dltt)))
    financial = s.let((zero(ivst) + zero(ivao)) - (zero(dltt) + zero(dlc) + zero(pstk)))
    early = s.delta(working, 12) + s.delta(fixed, 12) + s.delta(financial, 12)
    late = ni - (oancf + ivncf + fincf) + (zero(sstk) - zero(prstkc) - zero(dv))
    return finite(ieee.div(F.when(year_of() <= 1989, early).otherwise(late), s.lag(at, 12)))


@operator
def hire_growth(s: Stage, emp: Column) -> Column:
    before = s.lag(emp, 12)
    growth = ieee.div(emp - before, F.lit(0.5) * (emp + before))
    return F.when(F.col("compustat"), F.when(emp.isNull() | before.isNull(), F.lit(0.0)).otherwise(growth))


@operator
def bmdec_signal(s: Stage, ceq: Column, txditc: Column, seq: Column, at: Column, lt: Column, pstk: Column, pstkrv: Column, pstkl: Column, prc: Column, shrout: Column) -> Column:
    """Book equity over the market equity of the December before the last one that had passed by June."""
    value = s.let(F.when(month_of() == 12, F.abs(prc) * shrout))
    by_year = W.partitionBy("e").orderBy(year_of())  # frames of years, so that months before the first row do not matter
    last, earlier = (s.let(F.min(value).over(by_year.rangeBetween(-k, -k))) for k in (1, 2))
    preferred = F.coalesce(pstk, pstkrv, pstkl)
    equity = F.coalesce(seq, ceq + preferred, at - lt)
    book = equity + F.coalesce(txditc, F.lit(0.0)) - preferred
    return finite(ieee.div(book, F.when(month_of() >= 6, last).otherwise(earlier)))
