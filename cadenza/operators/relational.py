"""Operators that join tables: links, holds, point-in-time rows, streaks and recommendations.

Tables used (columns beside the keys are named in the code): universe (e, m, firm, ticker, prc, mve), statement_month
(e, m), statement_year (firm, e, m, fyear, datadate), statement_quarter (firm, m), estimates and estimates_adjusted
(ticker, m), recommendations (ticker, analyst, day), actuals (ticker, m), distributions (e, m, codes cd1..cd4).
Everything is an equi-join on (ticker, m), (firm, m) or (e, m), or a window along one firm, ticker or entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.functions.bins import nearest_quantile, percent_rank, qcut_bin
from cadenza.functions.ieee import clean, div, finite, holds, indicator, number
from cadenza.operators.elementwise import month_of, year_of
from cadenza.operators.masks import span
from cadenza.operators.regression import grouped_ols, unfolded
from cadenza.operators.registry import operator
from cadenza.plans.stage import Stage


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in that order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def month_number(day: Column | str) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def hold(df: DataFrame, months: int) -> DataFrame:
    """Rows repeated for the months that follow their stamp; the newest stamp wins.

    Every stamp is sent on to ``months`` rows, whatever the others are, so hot entities need no special treatment.
    """
    spread = df.withColumn("stamp", F.col("m")).withColumn("m", F.explode(F.sequence(F.col("stamp"), F.col("stamp") + (months - 1))))
    return first_by(spread, ["e", "m"], F.desc("stamp")).drop("stamp")


def as_value(df: DataFrame, column: str) -> DataFrame:
    """Rows (e, m, value); of several rows for one cell the last by value is taken, which makes ties definite."""
    return df.where(F.col(column).isNotNull()).groupBy("e", "m").agg(F.max(column).alias("value"))


def ticker_rows(s: Stage) -> DataFrame:
    """Universe rows with a ticker; a ticker shared by several entities goes to each of them."""
    return s.table("universe").where("ticker IS NOT NULL").select("e", "m", "ticker")


def link_months(s: Stage, values: DataFrame, column: str) -> Column:
    """Attach a (ticker, m) value to the universe."""
    return s.attach(as_value(ticker_rows(s).join(values, ["ticker", "m"]), column))


@operator
def cash_rdq_signal(s: Stage, *children: Column) -> Column:
    q = s.table("statement_quarter").where("rdq IS NOT NULL").select("firm", "rdq", "datadateq", "fyearq", "fqtr", "cheq", "atq")
    one = first_by(q, ["firm", "rdq"], F.desc("fyearq"), F.desc("fqtr"), F.desc("datadateq"))
    spread = one.withColumn("m", F.explode(F.sequence(month_number("rdq"), month_number("rdq") + 2)))
    newest = first_by(spread, ["firm", "m"], F.desc("rdq"), F.desc("datadateq"))
    universe = s.table("universe").where("firm IS NOT NULL").select("e", "m", "firm")
    return s.attach(as_value(universe.join(newest, ["firm", "m"]).select("e", "m", F.when(F.col("atq") > 0, div(F.col("cheq"), F.col("atq"))).alias("v")), "v"))


@operator
def earnings_increase_streak(s: Stage, *children: Column) -> Column:
    """Number of quarters, up to eight, of increases over the year before that a non-increase ends."""
    universe = s.table("universe").where("firm IS NOT NULL").select("e", "m", "firm")
    rows = first_by(universe.join(s.table("statement_quarter").select("firm", "m", "ibq"), ["firm", "m"]), ["e", "m"], "firm", "ibq")
    income = s.attach(rows.select("e", "m", F.col("ibq").alias("value")))
    there = s.attach(rows.select("e", "m", F.lit(1.0).alias("value")))
    change = s.let(F.when(there.isNotNull(), income - s.lag(income, 12)))
    lags = [change, *(s.lag(change, 3 * k) for k in range(1, 9))]
    out, run = F.lit(0.0), F.lit(True)
    for k in range(1, 9):
        run = run & (holds(lags[k - 1] > 0) | lags[k - 1].isNull())
        out = F.when(run & holds(lags[k] <= 0), F.lit(float(k))).otherwise(out)
    return F.when(there.isNotNull(), out)


def _annual_hold(s: Stage, rows: DataFrame, present_first: bool = False) -> Column:
    """Rows (firm, e, m, datadate, v) held for 12 months: the latest statement of a firm, then the first firm of an
    entity (``present_first``: of those with a value).  A missing value hides older statements as well.
    """
    spread = rows.withColumn("m", F.explode(F.sequence(F.col("m"), F.col("m") + 11)))
    latest = first_by(spread, ["firm", "m"], F.desc("datadate"), "e")
    order = [F.col("v").isNull(), "firm"] if present_first else ["firm"]
    return s.attach(first_by(latest, ["e", "m"], *order).where("v IS NOT NULL").select("e", "m", F.col("v").alias("value")))


def _years(s: Stage, columns: list[str]) -> DataFrame:
    return s.table("statement_year").select("firm", "e", "m", "fyear", "datadate", *columns)


@operator
def brand_invest_signal(s: Stage, *children: Column) -> Column:
    """Advertising over brand capital, a stock that keeps half of itself each year.

    The recursion is a power-weighted sum: each year's stock is the sum of earlier spending times 0.5 per row since, which
    is a running sum of spending times 2 per row, brought back.
    """
    along = W.partitionBy("firm").orderBy("fyear", "datadate")
    rows = _years(s, ["xad", "xad0", "at", "sic"]).withColumn("row", F.row_number().over(along))
    start = F.when(F.col("row") == 1, F.coalesce(F.col("xad") / F.lit(0.6), F.lit(0.0))).otherwise(F.coalesce("xad", F.lit(0.0)))
    grown = F.sum(start * F.pow(F.lit(2.0), F.col("row"))).over(along.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("stock", grown * F.pow(F.lit(0.5), F.col("row")))
    capital = F.when(F.col("xad").isNotNull(), div(F.col("stock"), F.col("at")))
    rows = rows.withColumn("capital", capital).withColumn("v", div(F.col("xad0"), F.lag("capital").over(along)))
    sic = number(F.col("sic"))
    out = holds(sic.between(4900, 4999)) | holds(sic.between(6000, 6999))
    return _annual_hold(s, rows.where(~out & (F.month("datadate") == 12)).select("firm", "e", "m", "datadate", "v"))


@operator
def equity_duration_signal(s: Stage, *children: Column) -> Column:
    along = W.partitionBy("firm").orderBy("fyear", "datadate")
    rows = _years(s, ["ceq", "ib", "sale", "prcc_f", "csho"])
    roe = div(F.col("ib"), F.lag("ceq").over(along))
    growth = ieee.finite(div(F.col("sale"), F.lag("sale").over(along)) - 1)
    rows = rows.withColumn("roe", roe).withColumn("growth", F.coalesce(growth, F.lit(0.0)))
    # Persistence of returns and of growth, their long-run levels, horizon in years.
    keep_roe, cost, keep_growth, long_growth, horizon = 0.57, 0.12, 0.24, 0.06, 10
    r, g, book = F.col("roe"), F.col("growth"), F.col("ceq")
    weighted, present = F.lit(0.0), F.lit(0.0)
    for t in range(1, horizon + 1):
        rows = rows.withColumn(f"r{t}", keep_roe * r + cost * (1 - keep_roe)).withColumn(f"g{t}", keep_growth * g + long_growth * (1 - keep_growth))
        rows = rows.withColumn(f"b{t}", book * (1 + F.col(f"g{t}")))
        paid = book - F.col(f"b{t}") + book * F.col(f"r{t}")
        rows = rows.withColumn(f"p{t}", paid / F.lit((1 + cost) ** t))
        weighted, present = weighted + t * F.col(f"p{t}"), present + F.col(f"p{t}")
        r, g, book = F.col(f"r{t}"), F.col(f"g{t}"), F.col(f"b{t}")
    size = F.col("prcc_f") * F.col("csho")
    value = div(weighted, size) + (horizon + (1 + cost) / cost) * (1 - div(present, size))
    return _annual_hold(s, rows.select("firm", "e", "m", "datadate", clean(value).alias("v")), present_first=True)


def ratio(a: Column, b: Column) -> Column:
    """a / b as numbers divide: 0/0 is NaN, missing operands alone make it missing."""
    return F.when((a == 0) & (b == 0), F.lit(float("nan"))).otherwise(div(a, b))


@operator
def abnormal_accruals_signal(s: Stage, *children: Column) -> Column:
    """Accruals less those expected from sales and fixed assets, by coefficients and bounds of the year before.

    Bounds are nearest ranks of all values of a year, each quantity by itself; a year's values lie in one list, whose
    length is the number of firms.  A year's fit leaves out what its own bounds cut off; a firm is scored by the bounds
    and coefficients of the year before.  Years that a firm left out lend 1 / assets once more to their last year's pool.
    """
    rows = first_by(_years(s, ["oancf", "fopt", "act", "che", "lct", "dlc", "ib", "sale", "ppegt", "at", "sic"]), ["firm", "fyear"], F.desc("datadate"), "e")
    along = W.partitionBy("firm").orderBy("fyear")
    before = along.rangeBetween(-1, -1)
    rows = rows.select("*", F.lead("fyear").over(along).alias("following"), *(F.max(c).over(before).alias(f"l_{c}") for c in ("act", "che", "lct", "dlc", "sale", "at")))
    change = lambda c: F.col(c) - F.col(f"l_{c}")
    cash = F.coalesce("oancf", F.col("fopt") - change("act") + change("che") + change("lct") - change("dlc"))
    names = ["y", "x1", "x2", "x3"]
    parts = [F.col("ib") - cash, F.lit(1.0), change("sale"), F.col("ppegt")]
    skipped = F.when(F.col("following") > F.col("fyear") + 1, ratio(F.lit(1.0), F.col("at")))
    rows = rows.select("firm", "e", "m", "fyear", "datadate", F.floor(number(F.col("sic")) / 100).alias("industry"), skipped.alias("skipped"), *(ratio(x, F.col("l_at")).alias(n) for x, n in zip(parts, names, strict=True)))
    pool = lambda c: F.sort_array(F.concat(F.collect_list(c), F.collect_list("skipped")) if c == "x1" else F.collect_list(c))
    pools = rows.groupBy("fyear").agg(*(pool(c).alias(c) for c in names))
    bounds = pools.select("fyear", *(nearest_quantile(F.col(c), q).alias(f"{side}_{c}") for c in names for side, q in (("lo", 0.001), ("hi", 0.999))))
    present = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names) + " AND industry IS NOT NULL")
    inside = reduce(lambda x, y: x & y, [~(holds(F.col(c) < F.col(f"lo_{c}")) | holds(F.col(c) > F.col(f"hi_{c}"))) for c in names])
    fits = grouped_ols(present.join(F.broadcast(bounds), "fyear").where(inside), ["fyear", "industry"], "y", names[1:], 6, least_norm=True)
    last = lambda df: df.withColumn("fyear", F.col("fyear") + 1)
    scored = present.join(F.broadcast(last(bounds)), "fyear").where(inside).join(last(fits.select("fyear", "industry", "b0", "b1", "b2", "b3")), ["fyear", "industry"])
    v = F.col("y") - (F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2") + F.col("b3") * F.col("x3"))
    scored = rows.select("firm", "e", "m", "fyear", "datadate").join(scored.select("firm", "fyear", clean(v).alias("v")), ["firm", "fyear"], "left")
    exchange = s.table("universe").select("e", "m", "exchcd")
    kept = scored.join(exchange, ["e", "m"], "left").where(~holds((F.col("exchcd") == 3) & (F.col("fyear") < 1982)))
    first = first_by(kept, ["e", "fyear"], "firm").where("v IS NOT NULL")
    return s.attach(hold(first.select("e", "m", F.col("v").alias("value")), 12))


def _valuation(s: Stage, growth_rows: int = 60) -> DataFrame:
    """June rows: forecast and realised returns on equity and the two value estimates, with screens applied."""
    along = W.partitionBy("e").orderBy("m")
    shares = s.table("stock_month").groupBy("e", "m").agg(F.max("shrout").alias("shrout"))
    items = ["ceq", "ibcom", "sale", "dvc", "at"]
    statement = first_by(s.table("statement_month").select("e", "m", "datadate", *items), ["e", "m"], F.desc("datadate"))
    rows = s.table("universe").select("e", "m", "ticker", F.abs("prc").alias("prc")).join(shares, ["e", "m"], "left").join(statement, ["e", "m"], "left")
    # Rows of the universe, not months: gaps are bridged here, as for last June's equity.
    rows = rows.withColumn("sg", ratio(F.col("sale"), F.lag("sale", growth_rows).over(along))).where("m % 12 = 5")
    rows = rows.withColumn("ceq_l", F.lag("ceq").over(along))

    def estimate(kind: str, name: str) -> DataFrame:
        found = s.table("estimates").where(F.col("fpi") == kind)
        if kind != "0":  # of May, for June
            found = found.where(F.month("statpers") == 5)
            found = found.where(F.col("fpedats") > F.date_add("statpers", 30)) if kind == "1" else found
            found = found.withColumn("m", F.col("m") + 1)
        return found.groupBy("ticker", "m").agg(F.max("meanest").alias(name))

    for kind, name in (("1", "feps1"), ("2", "feps2"), ("0", "ltg")):
        rows = rows.join(estimate(kind, name), ["ticker", "m"], "left")
    ceq, k, roe, froe1 = (F.col(c) for c in ("ceq", "k", "roe", "froe1"))
    grown = lambda book, rate: F.col(book) * (1 + F.col(rate) * (1 - k))
    steps = {
        "equity": F.coalesce((ceq + F.col("ceq_l")) / 2, ceq),
        "size": F.col("shrout") * F.col("prc"),
        "bm": ratio(ceq, F.col("size")),
        "k": F.when(F.col("ibcom") < 0, ratio(F.col("dvc"), 0.06 * F.col("at"))).otherwise(ratio(F.col("dvc"), F.col("ibcom"))),
        "roe": ratio(F.col("ibcom"), F.col("equity")),
        "froe1": ratio(F.col("feps1") * F.col("shrout"), F.col("equity")),
        "ceq1": grown("ceq", "froe1"),
        "own1": grown("ceq", "roe"),
        "froe2": ratio(F.col("feps2") * F.col("shrout"), (F.col("ceq1") + ceq) / 2),
        "ceq2": grown("ceq1", "froe1"),
        "own2": grown("own1", "roe"),
        "froe3": F.when(F.col("ltg").isNull(), F.col("froe2")).otherwise(ratio(F.col("feps2") * (1 + F.col("ltg") / 100) * F.col("shrout"), (F.col("ceq1") + F.col("ceq2")) / 2)),
        "ceq3": grown("ceq2", "froe2"),
    }
    for name, column in steps.items():
        rows = rows.withColumn(name, column)
    # Fixed value: cost of equity.
    rate = 0.12
    extra = lambda name: F.col(name) - rate
    forecast = F.col("ceq1") * (1 + extra("froe1") / (1 + rate)) + extra("froe2") / (1 + rate) ** 2 * F.col("ceq2") + extra("froe3") / ((1 + rate) ** 2 * rate) * F.col("ceq3")
    realised = F.col("own1") * (1 + extra("roe") / (1 + rate)) + extra("roe") / ((1 + rate) * rate) * F.col("own2")
    rows = rows.withColumn("value", clean(ratio(forecast, F.col("size")))).withColumn("intrinsic", clean(ratio(realised, F.col("size"))))
    rows = rows.withColumn("optimism", clean(ratio(F.col("value") - F.col("intrinsic"), F.abs("intrinsic"))))
    # A ratio of missing items passes its screen; 0/0, which is NaN and so above every number, does not.
    screen = (ceq > 0) & ((F.abs(roe) <= 1) | roe.isNull()) & ((F.abs(froe1) <= 1) | froe1.isNull()) & ((k <= 1) | k.isNull())
    rows = rows.where(screen & (F.month("datadate") >= 6) & F.col("feps1").isNotNull() & F.col("feps2").isNotNull())
    return first_by(rows, ["e", "m"], "ticker").select("e", "m", "value", "intrinsic", "optimism", "roe", "froe1", *(clean(F.col(c)).alias(c) for c in ("sg", "bm", "ltg")))


@operator
def analyst_value_signal(s: Stage, *children: Column) -> Column:
    return s.attach(hold(_valuation(s).select("e", "m", "value"), 12))


@operator
def analyst_optimism_ratio(s: Stage, *children: Column) -> Column:
    return s.attach(hold(_valuation(s).select("e", "m", F.col("optimism").alias("value")), 12))


@operator
def predicted_forecast_error(s: Stage, *children: Column, horizon_months: int = 12, growth_rows: int = 60) -> Column:
    """Forecast errors explained by last June's ranks of four traits; the coefficients score this June's ranks.

    Every June is fitted, by the solution of least norm where rows do not suffice: zeros without any.
    """
    traits = ["sg", "bm", "optimism", "ltg"]
    before = W.partitionBy("e").orderBy("m").rangeBetween(-12, -12)
    rows = _valuation(s, growth_rows).withColumn("error", F.max("froe1").over(before) - F.col("roe"))
    pools = rows.groupBy("m").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    bounds = pools.select("m", nearest_quantile(F.col("errors"), 0.01).alias("lo"), nearest_quantile(F.col("errors"), 0.99).alias("hi"))
    rows = rows.join(F.broadcast(bounds), "m")
    ranked = rows.select("e", "m", F.when(F.col("error").between(F.col("lo"), F.col("hi")), F.col("error")).alias("y"), *(percent_rank(F.col(c), F.col("m")).alias(f"r_{c}") for c in traits))
    ranked = ranked.select("*", *(F.max(f"r_{c}").over(before).alias(f"l_{c}") for c in traits))
    fits = grouped_ols(ranked, ["m"], "y", [f"l_{c}" for c in traits], 0, least_norm=True)
    score = F.col("b0")
    for i, c in enumerate(traits, 1):
        score = score + F.col(f"b{i}") * F.col(f"r_{c}")
    return s.attach(hold(ranked.join(F.broadcast(fits), "m").select("e", "m", score.alias("value")).where("value IS NOT NULL"), 12))


@operator
def frontier_signal(s: Stage, at: Column, ceq: Column, dltt: Column, capx: Column, sale: Column, xrd: Column, xad: Column, ppent: Column, ebitda: Column, mve: Column, industry: Column) -> Column:
    """Fitted less actual log market equity, from a regression pooled over the trailing 60 months, with industry effects.

    All that a month needs is the sum of the moments of its 60 months by industry, so the panel is aggregated once and
    never joined with itself; a fit sees one row for each industry, and is of least norm where rows do not suffice.
    """
    y = ieee.finite(ieee.ln(mve))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    xs = [ieee.ln(ceq), div(dltt, at), div(capx, sale), div(xrd, sale), div(zero(xad), sale), div(ppent, at), div(ebitda, at)]
    names = [f"x{i}" for i in range(7)]
    rows = s.df.where(F.col("strict") & (ceq > 0)).select("e", "m", industry.alias("industry"), y.alias("y"), *(ieee.finite(x).alias(n) for x, n in zip(xs, names, strict=True)))
    whole = rows.dropna(subset=["y", "industry", *names])
    terms = [F.lit(1.0), *map(F.col, names), F.col("y")]
    pairs = [(i, j) for i in range(9) for j in range(i, 9)]
    monthly = whole.groupBy("industry", "m").agg(*(F.sum(terms[i] * terms[j]).alias(f"s_{i}_{j}") for i, j in pairs))
    spread = monthly.withColumn("m", F.explode(F.sequence(F.col("m"), F.col("m") + 59)))
    pooled = spread.groupBy("industry", "m").agg(*(F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i, j in pairs))
    columns = [f"s_{i}_{j}" for i, j in pairs]

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        own = unfolded(part[columns].to_numpy(float), 9)  # of (1, x1..x7, y), by industry
        total, n = own.sum(axis=0), len(own)
        if total[0, 0] < 3:
            return pd.DataFrame({"m": [], "industry": [], **{f"b{i}": [] for i in range(8)}})
        gram, right = np.zeros((8 + n, 8 + n)), np.concatenate([total[:8, 8], own[:, 0, 8]])
        gram[:8, :8], gram[:8, 8:], gram[8:, :8] = total[:8, :8], own[:, 0, :8].T, own[:, 0, :8]
        gram[8:, 8:] = np.diag(own[:, 0, 0])
        beta = np.linalg.pinv(gram, rcond=1e-13, hermitian=True) @ right
        return pd.DataFrame({"m": part["m"], "industry": part["industry"], "b0": beta[0] + beta[8:], **{f"b{i}": beta[i] for i in range(1, 8)}})

    kind = pooled.schema["industry"].dataType.simpleString()
    fits = pooled.groupBy("m").applyInPandas(fitted, f"m int, industry {kind}, " + ", ".join(f"b{i} double" for i in range(8)))
    scored = whole.join(fits, ["industry", "m"])
    fit = F.col("b0")
    for i in range(1, 8):
        fit = fit + F.col(f"b{i}") * F.col(f"x{i - 1}")
    return s.attach(as_value(scored.select("e", "m", (fit - F.col("y")).alias("v")), "v"))


@operator
def rd_ability_signal(s: Stage, *children: Column, years: int = 8, min_pairs: int = 6) -> Column:
    """Mean slope of sales growth on research intensity of one to five years before, in the top tercile of intensity.

    Slopes are over the pairs of the last ``years`` fiscal years.  One is dropped if, in a run of consecutive years, under
    half of the last rows had any research that many years before; shorter runs are not judged.
    """
    rows = first_by(_years(s, ["xrd", "sale"]), ["firm", "fyear"], F.desc("datadate"), "e")
    along = W.partitionBy("firm").orderBy("fyear")
    sale, xrd = F.when(F.col("sale") > 0, F.col("sale")), F.when(F.col("xrd") >= 0, F.col("xrd"))
    rows = rows.withColumn("y", F.ln(sale / F.lag(sale).over(along))).withColumn("x", F.log1p(xrd / sale)).withColumn("run", F.col("fyear") - F.row_number().over(along))
    frame = along.rangeBetween(-(years - 1), 0)
    recent = W.partitionBy("firm", "run").orderBy("fyear").rowsBetween(-(years - 1), 0)
    slopes = []
    for n in range(1, 6):
        rows = rows.withColumn(f"x{n}", F.max("x").over(along.rangeBetween(-n, -n)))
        pair = F.when(F.col("y").isNotNull(), F.col(f"x{n}"))
        sound = (F.count(pair).over(frame) >= min_pairs) & (F.min(pair).over(frame) < F.max(pair).over(frame))
        share = F.avg(F.when(F.col(f"x{n}") > 0, 1.0).otherwise(0.0)).over(recent)
        rare = (F.count(F.lit(1)).over(recent) >= min_pairs) & (share < 0.5)
        rows = rows.withColumn(f"slope{n}", clean(F.when(sound & ~rare, F.regr_slope(F.col("y"), F.col(f"x{n}")).over(frame))))
        slopes.append(F.col(f"slope{n}"))
    rows = rows.withColumn("ability", ieee.null_skipping_mean(slopes)).withColumn("intensity", F.when(F.col("xrd") > 0, F.col("xrd") / sale))
    ranked = Stage(rows)
    tercile = qcut_bin(ranked, F.col("intensity"), 3)
    return _annual_hold(s, ranked.df.select("firm", "e", "m", "datadate", F.when(tercile == 3, F.col("ability")).alias("v")))


@operator
def ms_signal(s: Stage, at: Column, ceq: Column, ni: Column, oancf: Column, fopt: Column, wcapch: Column, ib: Column, dp: Column, xrd: Column, capx: Column, xad: Column, revt: Column, mve: Column, sic: Column, niq: Column, atq: Column, saleq: Column, oancfy: Column, capxy: Column, xrdq: Column, fqtr: Column) -> Column:
    """Eight growth signals against industry medians in the lowest book-to-market quintile, at the statement's month.

    All windows run over an entity's rows in that sample alone: sums and deviations by calendar months, "three before"
    by rows.  Missing counts as +inf on both sides of a comparison.
    """
    bin_ = qcut_bin(s, s.let(F.when(F.col("strict") & (ceq > 0), finite(ieee.ln(div(ceq, mve))))), 5)
    given = {"ceq": ceq, "fopt": fopt, "wcapch": wcapch, "xad": xad, "niq": niq, "atq": atq, "saleq": saleq, "oancfy": oancfy, "capxy": capxy, "xrdq": xrdq, "fqtr": fqtr}
    industry = F.substring(F.floor(number(sic)).cast("bigint").cast("string"), 1, 2)
    low = s.df.where(holds(bin_ == 1)).select("e", "m", industry.alias("ind"), *(c.alias(n) for n, c in given.items())).where("ind IS NOT NULL")
    statement = s.table("statement_month").groupBy("e", "m").agg(F.max("datadate").alias("datadate"))
    group = W.partitionBy("ind", "m")
    rows = low.withColumn("n", F.count("*").over(group)).where("n >= 3").join(statement, ["e", "m"], "left")
    along = W.partitionBy("e").orderBy("m")
    three = lambda c: F.lag(c, 3).over(along)

    def rolled(c: Column, months: int, least: int, fn: Callable[[Column], Column]) -> Column:
        frame = along.rangeBetween(1 - months, 0)
        return F.when(F.count(finite(c)).over(frame) >= least, fn(finite(c)).over(frame))

    year = lambda c: rolled(c, 12, 12, F.avg) * 4
    quarter = lambda c: F.when(F.col("fqtr") == 1, F.col(c)).when(F.col("fqtr") > 1, F.col(c) - three(c))
    steps = {
        "capxq": quarter("capxy"), "cashq": quarter("oancfy"), "xrdq0": F.coalesce("xrdq", F.lit(0.0)), "sg": div(F.col("saleq"), three("saleq")),
        "income": year(F.col("niq")), "xrd": year(F.col("xrdq0")), "capx": year(F.col("capxq")),
        "cash": F.when(F.year("datadate") <= 1988, F.col("fopt") - F.col("wcapch")).otherwise(year(F.col("cashq"))),
        "mean_at": (F.col("atq") + three("atq")) / 2, "old_at": three("atq"),
        "roa": div(F.col("income"), F.col("mean_at")), "cfroa": div(F.col("cash"), F.col("mean_at")),
        "roa_sd": rolled(div(F.col("niq"), F.col("atq")), 48, 18, F.stddev_samp), "sg_sd": rolled(F.col("sg"), 48, 18, F.stddev_samp),
        "xrd_in": div(F.col("xrd"), F.col("old_at")), "capx_in": div(F.col("capx"), F.col("old_at")), "xad_in": div(F.coalesce("xad", F.lit(0.0)), F.col("old_at")),
    }
    for name, column in steps.items():
        rows = rows.withColumn(name, column)
    top = lambda c: F.coalesce(c, F.lit(ieee.INF))
    median = lambda c: top(F.median(c).over(group))
    signals = [top(F.col(c)) > median(c) for c in ("roa", "cfroa", "xrd_in", "capx_in", "xad_in")] + [top(F.col(c)) < median(c) for c in ("roa_sd", "sg_sd")]
    signals.append(top(F.col("cash")) > top(F.col("income")))
    score = sum((indicator(x) for x in signals[1:]), indicator(signals[0]))
    # Fixed value: a statement of fiscal month f is told in month (f + 6) mod 12, so one of June never is.
    told = ~holds(F.col("m") % 12 + 1 != (F.month("datadate") + 6) % 12)
    rows = rows.withColumn("score", score).withColumn("score", F.when(told, F.least(F.greatest("score", F.lit(1.0)), F.lit(6.0))))
    carried = rows.select("e", "m", F.last("score", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("value"))
    return s.attach(carried)


@operator
def feps_signal(s: Stage, *children: Column) -> Column:
    return link_months(s, s.table("estimates").where("fpi = '1'").select("ticker", "m", "meanest"), "meanest")


def _monthly_recommendations(s: Stage) -> DataFrame:
    """Mean of each analyst's last recommendation of a month: (ticker, m, level)."""
    rows = s.table("recommendations").where("ireccd IS NOT NULL").select("ticker", "analyst", "day", "ireccd", month_number("day").alias("m"))
    last = rows.groupBy("ticker", "m", "analyst").agg(F.max(F.struct("day", "ireccd")).getField("ireccd").alias("ireccd"))
    return last.groupBy("ticker", "m").agg(F.avg("ireccd").alias("level"))


@operator
def binary_recommendation_level(s: Stage, *children: Column, low_threshold: float, high_threshold: float) -> Column:
    level = F.when(F.col("level") > high_threshold, F.lit(1.0)).when(F.col("level") <= low_threshold, F.lit(0.0))
    return link_months(s, _monthly_recommendations(s).select("ticker", "m", level.alias("v")), "v")


@operator
def recommendation_change_indicator(s: Stage, *children: Column, direction: str, lag_months: int = 1) -> Column:
    """Against the previous row of the ticker, whatever its month; a first row has no change."""
    before = F.lag("level", lag_months).over(W.partitionBy("ticker").orderBy("m"))
    changed = F.col("level") < before if direction == "up" else F.col("level") > before
    return link_months(s, _monthly_recommendations(s).select("ticker", "m", indicator(holds(changed)).alias("v")), "v")


@operator
def change_in_recommendation_signal(s: Stage, *children: Column) -> Column:
    rows = _monthly_recommendations(s).withColumn("score", 6 - F.col("level"))
    return link_months(s, rows.select("ticker", "m", (F.col("score") - F.lag("score").over(W.partitionBy("ticker").orderBy("m"))).alias("v")), "v")


def _dividends(s: Stage, regular: bool, frequencies: list[int] | None = None) -> tuple[Column, Column | None]:
    """Dividends on strict rows, missing ones 0; for regular ones also the payment-frequency code.

    Regular payments of several frequencies in one month: those of the least code count.
    """
    rows = s.table("distributions").where(F.col("cd1") == 1)
    if not regular:
        paid = rows.where(F.col("cd2").isin(2, 3)).groupBy("e", "m").agg(F.sum("divamt").alias("value"))
        return s.let(F.when(F.col("strict"), F.coalesce(s.attach(paid), F.lit(0.0)))), None
    rows = rows.where((F.col("cd2") == 2) & F.col("divamt").isNotNull())
    rows = rows.where(F.col("cd3").isin(frequencies)) if frequencies else rows
    rows = first_by(rows.groupBy("e", "m", "cd3").agg(F.sum("divamt").alias("paid")), ["e", "m"], "cd3")
    paid = s.attach(rows.select("e", "m", F.col("paid").alias("value")))
    code = s.attach(rows.select("e", "m", F.col("cd3").cast("double").alias("value")))
    return paid, code


@operator
def dividend_initiation_flag(s: Stage, *children: Column, lookback_months: int = 12) -> Column:
    """The look-back is 24 months and the flag lasts 6, whatever ``lookback_months`` says."""
    paid, _ = _dividends(s, False)
    total = s.let(F.sum(paid).over(s.months(-23, 0)))
    begun = s.let(indicator(holds(paid > 0) & holds(s.lag(total, 1) < 1e-10)))
    return s.let(F.max(begun).over(s.months(-5, 0)))


@operator
def dividend_omission_flag(s: Stage, *children: Column, lookback_months: int = 12) -> Column:
    paid, _ = _dividends(s, False)
    inside = span(s, F.col("strict"))
    some = s.let(F.when(F.col("strict"), (paid > 0).cast("double")))
    any_ = F.lit(False)
    # Payment interval, months of regular payment, months since.
    for window, history, since in ((3, 18, 3), (6, 18, 6), (12, 24, 12)):
        count = s.let(F.sum(some).over(s.months(-(window - 1), 0)))
        once = s.let(F.when(inside, indicator(holds(count == 1))))
        regular = s.let(F.when(inside, indicator(holds(F.avg(once).over(s.months(-(history - 1), 0)) == 1))))
        any_ = any_ | (holds(count == 0) & holds(s.lag(count, 1) > 0) & holds(s.lag(regular, since) == 1))
    now = s.let(F.when(inside, indicator(any_)))
    return indicator(holds(F.sum(now).over(s.months(-1, 0)) == 1))


@operator
def seasonal_dividend_indicator(s: Stage, *children: Column, lag_months: int = 12) -> Column:
    paid, code = _dividends(s, True)
    paid, code = s.let(F.when(F.col("strict"), paid)), s.let(F.when(F.col("strict"), code))
    carried = s.let(F.last(code, ignorenulls=True).over(s.until))
    base = F.col("strict") & carried.isNotNull()
    keep = s.let(base & holds(carried != 2) & holds(carried < 6), "keep")
    some = s.let(F.when(keep, (F.coalesce(paid, F.lit(0.0)) > 0).cast("double")))
    passes = {k: ~holds(s.lag(some, k) <= 0) for k in (2, 5, 8, 11)}
    code = F.when(F.col("strict"), carried)
    due = (holds(code.isin(0, 1, 3)) & (passes[2] | passes[5] | passes[8] | passes[11])) | (holds(code == 4) & (passes[5] | passes[11])) | (holds(code == 5) & passes[11])
    recent = s.let(F.sum(some).over(s.months(-11, 0)))
    return F.when(span(s, keep), F.when(due, F.lit(1.0)).when(recent > 0, F.lit(0.0)))


@operator
def divyieldst_signal(s: Stage, divamt: Column, distcd: Column, prc: Column) -> Column:
    paid, code = _dividends(s, True, [3, 4, 5])
    paid = s.let(F.when(F.col("strict"), F.coalesce(paid, F.lit(0.0))))
    carried = s.let(F.last(F.when(F.col("strict"), code), ignorenulls=True).over(s.until))
    expected = F.when(carried == 4, s.lag(paid, 5)).when(carried == 5, s.lag(paid, 11)).otherwise(s.lag(paid, 2))
    yearly = s.let(F.sum(paid).over(s.months(-11, 0)))
    rate = s.let(F.when(yearly > 0, div(expected, F.abs(F.when(F.col("strict"), prc)))))
    tercile = qcut_bin(s, s.let(F.when(rate > 0, rate)), 3)
    return F.when(rate == 0, F.lit(0.0)).otherwise(tercile.cast("double"))


def _entity_estimates(s: Stage, values: DataFrame, column: str) -> Column:
    return s.attach(as_value(ticker_rows(s).join(values, ["ticker", "m"]), column))


@operator
def sum_scaled_revisions(s: Stage, *children: Column, months: int = 6) -> Column:
    along = W.partitionBy("ticker").orderBy("m")
    rows = first_by(s.table("estimates").where("fpi = '1'"), ["ticker", "m"], F.desc("statpers"), "meanest")
    rows = rows.withColumn("last", F.lag("meanest").over(along)).withColumn("end", F.lag("fpedats").over(along))
    fresh = holds(F.col("fpedats") > F.date_add("statpers", 30))
    same = ~fresh & holds(F.col("fpedats") == F.col("end")) & F.col("last").isNotNull()
    estimate = _entity_estimates(s, rows.select("ticker", "m", F.when(same, F.col("last")).otherwise(F.col("meanest")).alias("v")), "v")
    price = s.attach(as_value(s.table("universe").select("e", "m", "prc"), "prc"))
    revision = s.let(div(estimate - s.lag(estimate, 1), F.abs(s.lag(price, 1))))
    frame = s.months(-months, 0)
    return s.let(F.when(F.count(revision).over(frame) == months + 1, clean(F.sum(revision).over(frame))))


@operator
def earnings_forecast_disparity_signal(s: Stage, *children: Column) -> Column:
    e = s.table("estimates")
    short = _entity_estimates(s, e.where("fpi = '1'").where(F.col("fpedats") > F.date_add("statpers", 30)).select("ticker", "m", "meanest"), "meanest")
    long = _entity_estimates(s, e.where("fpi = '0'").select("ticker", "m", "meanest"), "meanest")
    actual = _entity_estimates(s, s.table("actuals").select("ticker", "m", "fy0a"), "fy0a")
    return long - F.when(actual != 0, 100 * (short - actual) / F.abs(actual))


@operator
def excluded_expenses_signal(s: Stage, *children: Column) -> Column:
    universe = s.table("universe").where("firm IS NOT NULL").select("e", "m", "firm", "ticker")
    rows = universe.join(s.table("statement_quarter").select("firm", "m", "epspiq"), ["firm", "m"]).join(s.table("actuals").select("ticker", "m", "int0a"), ["ticker", "m"], "left")
    rows = rows.withColumn("v", F.col("int0a") - F.col("epspiq"))
    month = W.partitionBy("m")
    low, high = (F.percentile("v", F.lit(q)).over(month) for q in (0.01, 0.99))
    return s.attach(as_value(rows.where("v IS NOT NULL").select("e", "m", F.least(F.greatest("v", low), high).alias("v")), "v"))


@operator
def chforecast_accrual_signal(s: Stage, *children: Column) -> Column:
    """Direction of the estimate against the previous row, in the upper half of accruals."""
    rows = first_by(s.table("statement_month").select("e", "m", "act", "che", "lct", "dlc", "txp", "at"), ["e", "m"], "at")
    along = W.partitionBy("e").orderBy("m")
    for c in ("act", "che", "lct", "dlc", "txp", "at"):
        rows = rows.withColumn(f"l_{c}", F.max(c).over(along.rangeBetween(-12, -12)))
    change = lambda c: F.col(c) - F.col(f"l_{c}")
    mean = F.nullif((F.col("at") + F.col("l_at")) / 2, F.lit(0.0))
    rows = rows.withColumn("accruals", clean((change("act") - change("che") - (change("lct") - change("dlc") - change("txp"))) / mean))
    estimates = s.table("estimates").where("fpi = '1'").groupBy("ticker", "m").agg(F.max("meanest").alias("meanest"))
    rows = rows.join(first_by(ticker_rows(s), ["e", "m"], "ticker"), ["e", "m"], "left").join(estimates, ["ticker", "m"], "left")
    halves = Stage(rows)
    half = qcut_bin(halves, F.col("accruals"), 2)
    rows = halves.df.withColumn("half", half).withColumn("last", F.lag("meanest").over(along))
    moved = F.when(F.col("meanest") > F.col("last"), F.lit(1.0)).when(F.col("meanest") < F.col("last"), F.lit(0.0))
    return s.attach(as_value(rows.where(~holds(F.col("half") == 1)).select("e", "m", moved.alias("v")), "v"))


@operator
def fgr5yr_lag_signal(s: Stage, *children: Column) -> Column:
    needed = ["ceq", "ib", "txdi", "dv", "sale", "ni", "dp"]
    statement = first_by(s.table("statement_month").select("e", "m", *needed), ["e", "m"], "ceq").dropna(subset=needed)
    growth = s.table("estimates").where("fpi = '0'").select("ticker", "m", "meanest")
    rows = as_value(statement.join(ticker_rows(s), ["e", "m"]).join(growth, ["ticker", "m"]), "meanest")
    lagged = rows.select("e", "m", F.max("value").over(W.partitionBy("e").orderBy("m").rangeBetween(-6, -6)).alias("value"))
    return s.attach(hold(lagged.where((F.col("m") % 12 == 5) & F.col("value").isNotNull()), 12))


@operator
def sfe_signal(s: Stage, *children: Column) -> Column:
    march = s.table("estimates").where((F.col("fpi") == "1") & (F.month("statpers") == 3) & (F.col("fpedats") > F.date_add("statpers", 90)))
    priced = s.table("universe").where("ticker IS NOT NULL").select("e", "ticker", (F.col("m") + 3).alias("m"), "prc")
    statement = s.table("statement_month").where(F.month("datadate") == 12).select("e", "m").distinct()
    rows = Stage(march.select("ticker", "m", "medest", "numest").join(priced, ["ticker", "m"]).join(statement, ["e", "m"]))
    half = qcut_bin(rows, F.col("numest").cast("double"), 2)
    values = as_value(rows.df.where(half == 1).select("e", "m", div(F.col("medest"), F.abs("prc")).alias("v")), "v")
    return s.attach(hold(values, 12))


@operator
def earnings_streak_signal(s: Stage, *children: Column) -> Column:
    rows = s.table("estimates_adjusted").where("fpi = '6' AND actual IS NOT NULL AND meanest IS NOT NULL AND price IS NOT NULL")
    rows = first_by(rows.withColumn("m", month_number("anndats_act")), ["ticker", "m"], F.desc("anndats_act"), F.desc("statpers"))
    rows = rows.withColumn("v", div(F.col("actual") - F.col("meanest"), F.col("price")))
    again = rows.withColumn("before", F.lag(F.signum("v")).over(W.partitionBy("ticker").orderBy("anndats_act"))).where(F.signum("v") == F.col("before"))
    panel = ticker_rows(s).join(again.select("ticker", "m", "v", F.col("m").alias("stamp")), ["ticker", "m"], "left")
    along = W.partitionBy("e").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    kept = panel.select("e", "m", F.last("v", True).over(along).alias("v"), F.last("stamp", True).over(along).alias("stamp"))
    return s.attach(as_value(kept.where(F.col("m") - F.col("stamp") <= 6), "v"))
