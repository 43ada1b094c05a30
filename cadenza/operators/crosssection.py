"""Operators across the entities of a month.

A month's cross-section is one window partition, so its size is the number of entities, not of rows of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.functions.bins import average_rank, fastxtile_bin, percent_rank, qcut_bin
from cadenza.functions.ieee import clean, div, drop_if, finite, holds, indicator, keep_if, number, or_infinite
from cadenza.operators import timeaxis
from cadenza.operators.elementwise import year_of
from cadenza.operators.masks import span
from cadenza.operators.registry import operator
from cadenza.operators.regression import residuals_by_month
from cadenza.plans.stage import Stage


@operator
def size_filtered(s: Stage, x: Column, size: Column, min_tercile: int | None = 2, max_tercile: int | None = None, max_quintile: int | None = None, drop_missing_size: bool = False) -> Column:
    out, bins = F.lit(False), None
    if min_tercile is not None or max_tercile is not None:
        bins = qcut_bin(s, size, 3)
        out = out | holds(bins < (min_tercile or 0)) | holds(bins > (max_tercile or 3))
    if max_quintile is not None:
        bins = qcut_bin(s, size, 5)
        out = out | holds(bins > max_quintile)
    if drop_missing_size and bins is not None:
        out = out | bins.isNull()
    return F.when(~out, x)


@operator
def size_decile_filtered(s: Stage, x: Column, size: Column) -> Column:
    return drop_if(x, qcut_bin(s, s.let(F.when(F.col("compustat"), size)), 10) == 1)


@operator
def monthly_fastxtile_exclude(s: Stage, x: Column, key: Column, n: int = 5, max_excluded: int = 2) -> Column:
    return drop_if(x, fastxtile_bin(s, key, n) <= max_excluded)


def _prefix(code: Column, k: int) -> Column:
    """First characters of a code; whole numbers are written without a fraction."""
    whole = number(code)
    return F.substring(F.when(whole == F.floor(whole), whole.cast("bigint").cast("string")).otherwise(code.cast("string")), 1, k)


@operator
def industry_adjusted_mean(s: Stage, x: Column, sic: Column, count_basis: Column | None = None, min_industry_obs: int = 1) -> Column:
    industry = s.let(_prefix(sic, 2), "ind")
    value = s.let(F.when(industry.isNotNull(), finite(x)))
    part = s.across(industry)
    n = F.count(value if count_basis is None else count_basis).over(part)
    return s.let(F.when(n >= min_industry_obs, value - F.avg(value).over(part)))


@operator
def industry_weighted_momentum(s: Stage, ret: Column, mve_c: Column, sic: Column) -> Column:
    momentum = s.let(timeaxis.compound_return(s, ret, [1, 2, 3, 4, 5]))
    industry = s.let(_prefix(sic, 2), "ind")
    valid = momentum.isNotNull() & (mve_c > 0) & industry.isNotNull()
    part = s.across(industry)
    mean = div(F.sum(F.when(valid, momentum * mve_c)).over(part), F.sum(F.when(valid, mve_c)).over(part))
    return s.let(F.when(industry.isNotNull(), mean))


def _big_mean(s: Stage, x: Column, size: Column, industry: Column, big: Column) -> Column:
    return s.let(F.avg(F.when(big, x)).over(s.across(industry)))


@operator
def industry48(s: Stage, sic: Column) -> Column:
    """Industry number from table ``industries`` (low, high, industry): the class table comes as data.

    The few distinct codes are joined to the ranges, so the panel itself takes part in an equi-join only.
    """
    code = s.let(number(sic))
    ranges = F.broadcast(s.table("industries"))
    known = s.df.select(code.alias("code")).where("code IS NOT NULL").distinct().join(ranges, F.col("code").between(F.col("low"), F.col("high"))).groupBy("code").agg(F.min("industry").alias("industry"))
    s._count += 1
    s.df = s.df.join(known.select(F.col("code").alias(f"_c{s._count}"), F.col("industry").alias(f"_i{s._count}")), code == F.col(f"_c{s._count}"), "left")
    return F.col(f"_i{s._count}")


@operator
def industry_big_mean(s: Stage, x: Column, mve_c: Column, industry: Column) -> Column:
    """Mean of x over an industry's large members (size rank 0.7 and more), for its other members."""
    rank = s.let(F.when(industry.isNotNull(), percent_rank(F.when(industry.isNotNull(), mve_c), F.col("m"), industry)))
    big = holds(rank >= 0.7)
    return F.when(industry.isNotNull() & ~big, _big_mean(s, x, mve_c, industry, big))


@operator
def industry_big_return(s: Stage, ret: Column, mve_c: Column, industry: Column) -> Column:
    """The same with ranks above 0.7 as the pool and below 0.7, or missing, as receivers."""
    ret, mve_c, industry = (s.let(F.when(F.col("strict"), x)) for x in (ret, mve_c, industry))
    rank = s.let(F.when(industry.isNotNull(), percent_rank(F.when(industry.isNotNull(), mve_c), F.col("m"), industry)))
    mean = _big_mean(s, ret, mve_c, industry, holds(rank > 0.7))
    return F.when(industry.isNotNull() & ~holds(rank >= 0.7), mean)


@operator
def rolling_industry_herfindahl(s: Stage, metric: Column, sic: Column, shrcd: Column, window_months: int = 36, min_obs: int = 12, min_year: int | None = None, require_compustat_row: bool = False) -> Column:
    base = F.col("strict") & F.col("compustat") if require_compustat_row else F.col("strict")
    industry = s.let(F.when(base, _prefix(sic, 4)), "ind")
    value = s.let(F.when(base & industry.isNotNull(), metric))
    part = s.across(industry)
    share = s.let(div(value, F.sum(value).over(part)))
    index = s.let(F.when(industry.isNotNull(), F.coalesce(clean(F.sum(share * share).over(part)), F.lit(0.0))))
    frame = s.months(-(window_months - 1), 0)
    mean = s.let(clean(F.when(F.count(index).over(frame) >= min_obs, F.avg(index).over(frame))))
    inside = span(s, base)
    year = year_of()
    # Regulated industries and the last year of regulation.
    regulated = holds(industry.isin("4011", "4210", "4213") & (year <= 1980)) | holds((industry == "4512") & (year <= 1978)) | holds(industry.isin("4812", "4813") & (year <= 1982)) | holds(industry.startswith("49"))
    out = base & (holds(shrcd > 11) | regulated)
    return F.when(inside & ~out & (year >= (min_year or 0)), mean)


@operator
def weighted_lagged_rank_growth(s: Stage, revt: Column) -> Column:
    before = s.lag(revt, 12)
    # Equal ratios differ in the last place of their logarithms, which then decides their order.
    now = s.let(ieee.exact_ln(revt, s.let))
    growth = s.let(F.when((revt > 0) & (before > 0), now - s.let(ieee.exact_ln(before, s.let))))
    rank = s.let(F.when(growth.isNotNull(), F.row_number().over(W.partitionBy("m").orderBy(growth.desc_nulls_last(), "e"))).cast("double"))
    return (5 * s.lag(rank, 12) + 4 * s.lag(rank, 24) + 3 * s.lag(rank, 36) + 2 * s.lag(rank, 48) + s.lag(rank, 60)) / F.lit(15.0)


def _strict_returns(s: Stage, ret: Column) -> Column:
    return s.let(F.when(F.col("strict"), F.coalesce(ret, F.lit(0.0))))


@operator
def firm_age_momentum(s: Stage, ret: Column, prc: Column) -> Column:
    age = s.let(F.when(F.col("strict"), F.sum(F.col("strict").cast("int")).over(s.until)))
    kept = s.let(F.col("strict") & (prc.isNull() | (F.abs(prc) >= 5)) & holds(age >= 12))
    momentum = timeaxis.compound_return(s, s.let(F.when(kept, F.coalesce(ret, F.lit(0.0)))), [1, 2, 3, 4, 5])
    youngest = qcut_bin(s, s.let(F.when(kept, age.cast("double"))), 5) == 1
    return keep_if(momentum, kept & youngest)


@operator
def momentum_reversal_signal(s: Stage, ret: Column) -> Column:
    r = _strict_returns(s, ret)
    inside = span(s, F.col("strict"))
    short = qcut_bin(s, s.let(F.when(inside, timeaxis.compound_return(s, r, [1, 2, 3, 4, 5]))), 5)
    long = qcut_bin(s, s.let(F.when(inside, timeaxis.compound_return(s, r, list(range(13, 37))))), 5)
    return F.when((short == 5) & (long == 1), F.lit(1.0)).when((short == 1) & (long == 5), F.lit(0.0))


@operator
def momentum_volume_signal(s: Stage, ret: Column, vol: Column) -> Column:
    r = _strict_returns(s, ret)
    volume = timeaxis.rolling_mean(s, s.let(F.when(F.col("strict") & (vol >= 0), vol)), 6, 5)
    inside = span(s, F.col("strict"))
    decile = qcut_bin(s, s.let(F.when(inside, timeaxis.compound_return(s, r, [1, 2, 3, 4, 5]))), 10)
    tercile = qcut_bin(s, s.let(F.when(inside, volume)), 3)
    first = F.min(F.when(F.col("strict"), F.col("m"))).over(W.partitionBy("e"))
    history = s.let(F.col("m") - first >= 23)
    return keep_if(decile.cast("double"), (tercile == 3) & history)


@operator
def share_volume_signal(s: Stage, vol: Column, shrout: Column) -> Column:
    turnover = s.let(div(vol + s.lag(vol, 1) + s.lag(vol, 2), 3 * shrout) * 100)
    changed = s.let(holds(shrout != s.lag(shrout, 1)).cast("double"))
    recent = (changed == 1) | holds(s.lag(changed, 1) == 1) | holds(s.lag(changed, 2) == 1)
    prior = s.let(F.sum(F.col("strict").cast("int")).over(s.until) - 1)
    level = F.when(turnover.isNull() | (turnover > 10), F.lit(1.0)).when(turnover < 5, F.lit(0.0))
    return keep_if(level, F.col("strict") & (~recent | (prior < 2)))


@operator
def accruals_bm_signal(s: Stage, bm: Column, accruals: Column, ceq: Column) -> Column:
    b, a = fastxtile_bin(s, bm, 5), fastxtile_bin(s, accruals, 5)
    return keep_if(F.when((b == 5) & (a == 1), F.lit(1.0)).when((b == 1) & (a == 5), F.lit(0.0)), ceq >= 0)


def _nearest_bounds(values: DataFrame, low: float, high: float) -> DataFrame:
    """Elements floor(q (n - 1) + 0.5), from 0, of column x in ascending order, as one row (lo, hi).

    Ranks come from counts of distinct values, accumulated over value-range partitions: no single task sorts all rows.
    """
    counts = values.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    cells = counts.agg(F.sum("c").alias("n"))
    slices = counts.withColumn("slice", F.floor(F.log2(1 + F.abs("x")) * F.signum("x") * 64))
    totals = slices.groupBy("slice").agg(F.sum("c").alias("sc"))
    before = totals.withColumn("start", F.sum("sc").over(W.orderBy("slice")) - F.col("sc")).select("slice", "start")
    placed = slices.join(F.broadcast(before), "slice").withColumn("last", F.col("start") + F.sum("c").over(W.partitionBy("slice").orderBy("x")))
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1) + F.lit(0.5))
    joined = placed.crossJoin(F.broadcast(cells))
    pick = lambda q: F.min(F.when(F.col("last") > at(q), F.col("x")))
    return joined.agg(pick(low).alias("lo"), pick(high).alias("hi"))


@operator
def trim_global(s: Stage, x: Column, lower_q: float = 0.01, upper_q: float = 0.99) -> Column:
    value = s.let(finite(x))
    bounds = _nearest_bounds(s.df.select(value.alias("x")), lower_q, upper_q)
    s.df = s.df.crossJoin(F.broadcast(bounds.withColumnsRenamed({"lo": f"_lo{s._count}", "hi": f"_hi{s._count}"})))
    return keep_if(value, value.between(F.col(f"_lo{s._count}"), F.col(f"_hi{s._count}")))


@operator
def trim_by_month(s: Stage, x: Column, lower_q: float = 0.01, upper_q: float = 0.99) -> Column:
    part = s.across()
    low, high = s.let(F.percentile(x, F.lit(lower_q)).over(part)), s.let(F.percentile(x, F.lit(upper_q)).over(part))
    return keep_if(x, x.between(low, high))


@operator
def intangible_residual(s: Stage, measure: Column, ret: Column) -> Column:
    """Residual of the 60-month return on the measure 60 months ago and the measure's change plus the return."""
    base = F.col("strict") & F.col("compustat")
    measure = s.let(F.when(base, finite(measure)))
    cumulated = s.let(F.exp(F.sum(F.when(base, F.coalesce(ieee.log1p(ret), F.lit(0.0))).otherwise(F.lit(0.0))).over(s.until)))
    before = s.lag(cumulated, 60)
    both = base & holds(s.lag(s.let(base.cast("double")), 60) == 1)
    total = trim_by_month(s, s.let(F.when(both, finite(div(cumulated - before, before)))))
    total = s.let(total)
    earlier = s.lag(measure, 60)
    return residuals_by_month(s, total, [earlier, s.let(finite(measure - earlier + total))])


@operator
def piotroski_score(s: Stage, fopt: Column, oancf: Column, ib: Column, at: Column, dltt: Column, act: Column, lct: Column, txt: Column, xint: Column, sale: Column, ceq: Column, mve: Column, shrout: Column) -> Column:
    """Nine binary signals, for the top quintile of book to market; missing or infinite metrics count as +inf."""
    raw = {"fopt": fopt, "oancf": oancf, "ib": ib, "at": at, "dltt": dltt, "act": act, "lct": lct, "txt": txt, "xint": xint, "sale": sale, "ceq": ceq, "mve": mve, "shrout": shrout}
    rows = s.let(F.col("strict") & F.col("compustat") & F.col("listed"), "rows")
    u = {k: s.let(F.when(rows, v), k) for k, v in raw.items()}
    cash = s.let(F.coalesce(u["fopt"], u["oancf"]))
    ebit = s.let(u["ib"] + u["txt"] + u["xint"])
    change = lambda x: s.delta(s.let(x), 12)
    above = lambda x: or_infinite(clean(x)) > 0
    signals = [
        above(u["ib"]),
        above(cash),
        above(change(div(u["ib"], u["at"]))),
        above(cash - u["ib"]),
        or_infinite(change(div(u["dltt"], u["at"]))) < 0,
        above(change(div(u["act"], u["lct"]))),
        # Current profit over current and over last year's sales.
        above(div(ebit, u["sale"]) - div(ebit, s.lag(u["sale"], 12))),
        above(change(div(u["sale"], u["at"]))),
        or_infinite(clean(s.lag(u["shrout"], 12) - u["shrout"])) >= 0,
    ]
    score = sum((indicator(x) for x in signals[1:]), indicator(signals[0]))
    needed = [cash, u["ib"], u["at"], u["dltt"], u["act"], ebit, u["sale"], u["shrout"]]
    present = needed[0].isNotNull()
    for x in needed[1:]:
        present = present & x.isNotNull()
    top = qcut_bin(s, s.let(finite(ieee.ln(div(F.when(u["ceq"] > 0, u["ceq"]), u["mve"])))), 5) == 5
    return keep_if(score, present & top)


def _yield_sample(s: Stage, sic: Column, ceq: Column, also: Column) -> Column:
    code = number(sic)
    rows = F.col("strict") & F.col("compustat")
    return s.let(rows & holds((code < 6000) | (code >= 7000)) & ~holds(ceq <= 0) & also, "sample")


def _lagged_size(s: Stage, mve: Column) -> Column:
    return s.lag(s.let(F.when(F.col("strict") & F.col("compustat"), mve)), 6)


def _after_24(s: Stage, value: Column, sample: Column) -> Column:
    count = s.let(F.sum(sample.cast("int")).over(s.until))
    return keep_if(value, sample & (count >= 24))


@operator
def netpayout_yield_signal(s: Stage, dvc: Column, prstkc: Column, sstk: Column, mve: Column, sic: Column, ceq: Column) -> Column:
    value = s.let(div(dvc + prstkc - sstk, _lagged_size(s, mve)))
    nothing = holds(value == 0) & holds(dvc == 0) & holds(prstkc == 0) & holds(sstk == 0)
    return _after_24(s, value, _yield_sample(s, sic, ceq, ~nothing))


@operator
def payout_yield_signal(s: Stage, dvc: Column, prstkc: Column, pstkrv: Column, mve: Column, sic: Column, ceq: Column) -> Column:
    value = div(dvc + prstkc + pstkrv, _lagged_size(s, mve))
    return _after_24(s, F.when(value > 0, value), _yield_sample(s, sic, ceq, F.lit(True)))


@operator
def cs_rank(s: Stage, x: Column) -> Column:
    """Average rank scaled to (-1, 1): 2 rank / (n + 1) - 1."""
    n = F.count(x).over(W.partitionBy("m"))
    return s.let(2 * average_rank(x, F.col("m")) / (n + 1) - 1)
