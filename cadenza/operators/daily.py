"""From daily rows to months: statistics within months, rolling regressions, and event windows.

Tables: stock_day (e, d, ret, vol, prc, cfacpr, shrout), factors_day (d, mktrf, smb, hml, rf), stock_month, factors_month,
market_month, liquidity_month, universe, statement_quarter, links.  The daily table is shuffled by entity once for each
operator, is never pivoted, and gets the common series by a broadcast whose size is one row for each day.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.functions.bins import ranked_quantile
from cadenza.functions.ieee import clean, div, finite
from cadenza.operators.regression import moment_columns, rolling_coefficients, solve_moments, unfolded, with_coefficients
from cadenza.operators.registry import operator
from cadenza.operators.relational import as_value, first_by, hold, month_number
from cadenza.plans.stage import Stage


def days(s: Stage) -> DataFrame:
    return s.table("stock_day").where("d IS NOT NULL").withColumn("m", month_number("d"))


def with_factors(s: Stage, rows: DataFrame) -> DataFrame:
    """Inner join to the days of the factor series, one row for each of which is broadcast."""
    return rows.join(F.broadcast(s.table("factors_day")), "d")


#: Daily quantities that the monthly statistics can be taken of.
DERIVED = {
    None: lambda: F.col("ret"),
    "amihud": lambda: div(F.abs("ret"), F.abs("prc") * F.col("vol")),
    "zerovol": lambda: (F.col("vol") == 0).cast("double"),
    "turnover": lambda: div(F.col("vol"), F.col("shrout")),
    "one": lambda: F.lit(1.0),
    "absprc": lambda: F.abs("prc"),
}


def skewness(x: str) -> Column:
    """Population skewness; missing where the second moment is zero."""
    return F.when(F.min(x) < F.max(x), clean(F.skewness(x)))


def monthly_statistic(rows: DataFrame, stat: str, min_obs: int = 1, min_obs_mode: str = "valid", bias_adjusted: bool = False) -> DataFrame:
    """(e, m, value) of column x of rows (e, m, d, x); the gate counts present values, or all rows."""
    n = F.count("x")
    value = {
        "mean": lambda: F.avg("x"),
        "max": lambda: F.max("x"),
        "sum": lambda: F.coalesce(F.sum("x"), F.lit(0.0)),
        "std": lambda: F.when(n > 1, F.when(F.min("x") == F.max("x"), F.lit(0.0)).otherwise(F.stddev_samp("x"))),
        "skew": lambda: skewness("x") * (F.when(n > 2, F.sqrt((n * (n - 1)).cast("double")) / (n - 2)) if bias_adjusted else F.lit(1.0)),
        "last": lambda: F.max(F.struct("d", "x")).getField("x"),
    }[stat]()
    seen = F.count(F.lit(1)) if min_obs_mode == "rows" else n
    return rows.groupBy("e", "m").agg(F.when(seen >= min_obs, clean(value)).alias("value")).where("value IS NOT NULL")


@operator
def daily_monthly_stat(s: Stage, *children: Column, stat: str, min_obs: int = 1, min_obs_mode: str = "valid", bias_adjusted: bool = False, derive: str | None = None) -> Column:
    rows = days(s).select("e", "m", "d", clean(DERIVED[derive]()).alias("x"))
    return s.attach(monthly_statistic(rows, stat, min_obs, min_obs_mode, bias_adjusted))


@operator
def ff3_idio_stat(s: Stage, *children: Column, stat: str) -> Column:
    """Deviation or skewness of a month's residuals on three factors: moments are aggregated, then residuals."""
    rows = with_factors(s, days(s)).select("e", "m", (F.col("ret") - F.col("rf")).alias("y"), "mktrf", "smb", "hml").dropna()
    xs = ["mktrf", "smb", "hml"]
    fits = with_coefficients(rows.groupBy("e", "m").agg(*moment_columns(F.col("y"), [F.col(x) for x in xs])), 3, 15).where("b0 IS NOT NULL")
    fitted = F.col("b0") + sum((F.col(f"b{i}") * F.col(x) for i, x in enumerate(xs[1:], 2)), F.col("b1") * F.col(xs[0]))
    residuals = rows.join(fits, ["e", "m"]).select("e", "m", (F.col("y") - fitted).alias("x"))
    value = F.stddev_samp("x") if stat == "std" else F.when(F.stddev_pop("x") > 1e-10, F.skewness("x"))
    return s.attach(residuals.groupBy("e", "m").agg(clean(value).alias("value")))


def last_of_month(rows: DataFrame, column: str) -> DataFrame:
    """(e, m, value): the value of each month's last row, even a missing one."""
    return rows.groupBy("e", "m").agg(F.max(F.struct("d", column)).getField(column).alias("value"))


@operator
def rolling_market_rmse(s: Stage, *children: Column, window: int = 252, min_obs: int = 100) -> Column:
    rows = with_factors(s, days(s)).select("e", "m", F.unix_date("d").alias("d"), (F.col("ret") - F.col("rf")).alias("y"), F.col("mktrf").alias("x")).dropna()

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for part in filter(len, parts):
            known = part if kept is None else pd.concat([kept, part], ignore_index=True)
            e, m = known["e"].to_numpy(), known["m"].to_numpy()
            last = np.r_[(e[1:] != e[:-1]) | (m[1:] != m[:-1]), True]  # of its month, or of the batch
            rows = np.flatnonzero(last & (np.arange(len(e)) >= len(known) - len(part)))
            value = trailing_rmse(e, known["y"].to_numpy(float), known["x"].to_numpy(float), window, min_obs, rows)
            yield known.iloc[rows][["e", "m", "d"]].assign(v=value)
            kept = known.iloc[max(0, len(known) - window + 1) :]

    # Sliding frames would evaluate each of a window's rows again for each row, one at a time.
    fits = rows.repartition("e").sortWithinPartitions("e", "d").mapInPandas(fit, "e bigint, m int, d int, v double")
    return s.attach(last_of_month(fits.withColumn("v", clean(F.col("v"))), "v").where("value IS NOT NULL"))


#: Rows whose windows are laid out at a time.
ROWS = 4096


def trailing_rmse(e: np.ndarray, y: np.ndarray, x: np.ndarray, window: int, least: int, wanted: np.ndarray) -> np.ndarray:
    """Root mean square residual of y on x over an entity's last rows (n - 2 degrees of freedom), NaN where there is none.

    Rows are ordered by entity and time, ``wanted`` are positions.  Means are taken off in a first pass over each window.
    """
    out = np.full(len(wanted), np.nan)
    at = np.arange(len(e))
    starts = np.maximum.accumulate(np.where(np.r_[True, e[1:] != e[:-1]], at, 0))
    count = np.minimum(at - starts + 1, window)
    xs, ys = (np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(window - 1), v], window) for v in (x, y))
    enough = np.flatnonzero(count[wanted] >= least)
    for k in range(0, len(enough), ROWS):
        rows = wanted[enough[k : k + ROWS]]
        n = count[rows]
        inside = np.arange(window) >= window - n[:, None]
        with np.errstate(all="ignore"):
            px, py = np.where(inside, xs[rows], 0.0), np.where(inside, ys[rows], 0.0)
            dx, dy = (np.where(inside, v - (v.sum(axis=1) / n)[:, None], 0.0) for v in (px, py))
            sxx, sxy, syy = (np.einsum("rw,rw->r", a, b) for a, b in ((dx, dx), (dx, dy), (dy, dy)))
            varied = np.where(inside, px, x[rows, None]).min(axis=1) < np.where(inside, px, x[rows, None]).max(axis=1)
            rmse = np.sqrt(np.maximum(0.0, syy - sxy * sxy / sxx) / (n - 2))
        out[enough[k : k + ROWS]] = np.where(varied & (sxx > 0), rmse, np.nan)
    return out


def _stock_months(s: Stage) -> DataFrame:
    return first_by(s.table("stock_month").select("e", "m", "ret"), ["e", "m"], "ret")


def _carried(s: Stage, listed: DataFrame, values: DataFrame) -> Column:
    """Coefficients of valid months carried to the later rows of the entity, on rows of the table only."""
    joined = listed.select("e", "m").join(values, ["e", "m"], "left")
    along = W.partitionBy("e").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    return s.attach(joined.select("e", "m", F.last("value", True).over(along).alias("value")).where("value IS NOT NULL"))


@operator
def monthly_rolling_beta(s: Stage, *children: Column, x_dataset: str = "market_month", x_column: str = "ewretd", window: int = 60, min_obs: int = 20, y_excess: bool = False, x_excess: bool = False) -> Column:
    rows = _stock_months(s)
    series = s.table(x_dataset).select("m", F.col(x_column).alias("x")).join(s.table("factors_month").select("m", "rf"), "m", "left")
    joined = rows.join(F.broadcast(series), "m", "left")
    y = F.col("ret") - F.col("rf") if y_excess else F.col("ret")
    x = F.col("x") - F.col("rf") if x_excess else F.col("x")
    valid = joined.select("e", "m", y.alias("y"), x.alias("x")).dropna()
    frame = W.partitionBy("e").orderBy("m").rowsBetween(-(window - 1), 0)
    slope = F.when((F.count("y").over(frame) >= min_obs) & (F.min("x").over(frame) < F.max("x").over(frame)), F.regr_slope("y", "x").over(frame))
    return _carried(s, rows, valid.select("e", "m", clean(slope).alias("value")))


@operator
def monthly_rolling_multibeta(s: Stage, *children: Column, regressors: list[str], keep: int, window: int, min_obs: int) -> Column:
    """Slope of regressor number ``keep``; regressors are named table:column."""
    rows = _stock_months(s)
    joined = rows.join(F.broadcast(s.table("factors_month").select("m", "rf")), "m", "left")
    names = []
    for i, name in enumerate(regressors):
        table, column = name.split(":")
        names.append(f"x{i}")
        joined = joined.join(F.broadcast(s.table(table).select("m", F.col(column).alias(f"x{i}"))), "m", "left")
    valid = joined.select("e", "m", (F.col("ret") - F.col("rf")).alias("y"), *names).dropna()
    fits = rolling_coefficients(valid, "y", names, window, min_obs)
    return _carried(s, rows, fits.select("e", "m", F.col(f"b{keep + 1}").alias("value")))


@operator
def residual_momentum(s: Stage, *children: Column, reg_window: int = 36, mom_window: int = 11) -> Column:
    """Mean over deviation of the residuals of the eleven months before, each from its own trailing regression."""
    series = F.broadcast(s.table("factors_month").select("m", "mktrf", "smb", "hml", "rf"))
    valid = _stock_months(s).join(series, "m").select("e", "m", (F.col("ret") - F.col("rf")).alias("y"), "mktrf", "smb", "hml").dropna()
    fits = rolling_coefficients(valid, "y", ["mktrf", "smb", "hml"], reg_window, reg_window)
    fitted = F.col("b0") + F.col("b1") * F.col("mktrf") + F.col("b2") * F.col("smb") + F.col("b3") * F.col("hml")
    residual = s.attach(fits.select("e", "m", (F.col("y") - fitted).alias("value")).where("value IS NOT NULL"))
    mean, sd = ieee.null_skipping_stats([s.lag(residual, k) for k in range(1, mom_window + 1)])
    n = s.let(F.count(residual).over(s.months(-mom_window, -1)))
    return F.when(n == mom_window, div(mean, sd))


def _bucket(m: Column | str) -> Column:
    """Year of the June that ends the July-to-June year of a month."""
    m = F.col(m) if isinstance(m, str) else m
    return F.floor((m + 6) / 12).cast("int")


@operator
def price_delay(s: Stage, *children: Column, stat: str) -> Column:
    """Share of the explained return that comes with lags of the market, in each July-to-June year, stamped July.

    The restricted and unrestricted regressions come from one set of moments of five regressors.
    """
    market = s.table("factors_day").withColumn("_1", F.lit(1))
    order = W.orderBy("d")  # one row for each trading day
    lags = market.select("d", "rf", F.col("mktrf").alias("x0"), *(F.lag("mktrf", k).over(order).alias(f"x{k}") for k in range(1, 5)))
    names = [f"x{k}" for k in range(5)]
    rows = days(s).join(F.broadcast(lags), "d").withColumn("bucket", _bucket("m"))
    rows = rows.withColumn("y", F.col("ret") - F.col("rf"))
    moments = rows.groupBy("e", "bucket").agg(F.max("m").alias("last_m"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("x0").alias("xlo"), F.max("x0").alias("xhi"), *moment_columns(F.col("y"), [F.col(x) for x in names]))
    moments = moments.where((F.col("m_0_0") >= 26) & (F.col("lo") < F.col("hi")) & (F.col("xlo") < F.col("xhi")) & (F.col("last_m") % 12 == 5))
    pairs = [(i, j) for i in range(7) for j in range(i, 7)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = part[[f"m_{i}_{j}" for i, j in pairs]].to_numpy(float)
            coef, rss, n = solve_moments(m, 5, 26)
            one = part[[f"m_{i}_{j}" for i in (0, 1, 6) for j in (0, 1, 6) if i <= j]].to_numpy(float)
            _, rss1, _ = solve_moments(one, 1, 26)
            full = unfolded(m, 7)
            value = np.full(len(part), np.nan)
            good = np.flatnonzero(np.isfinite(coef).all(axis=1))
            with np.errstate(all="ignore"):
                mean = full[good, 0, 1:] / n[good, None]
                c = full[good, 1:, 1:] - n[good, None, None] * mean[:, :, None] * mean[:, None, :]
                weight = coef[good, 1:]
                if stat == "tstat":
                    scale = np.sqrt(np.einsum("rii->ri", c[:, :5, :5]))
                    inverse = np.linalg.inv(c[:, :5, :5] / (scale[:, :, None] * scale[:, None, :]))
                    weight = weight / np.sqrt(np.einsum("rii->ri", inverse) / scale**2 * (rss[good] / (n[good] - 6))[:, None])
                if stat in ("slope", "tstat"):
                    value[good] = (np.arange(5) * weight).sum(axis=1) / weight.sum(axis=1)
                else:
                    value[good] = 1 - (1 - rss1[good] / c[:, 5, 5]) / (1 - rss[good] / c[:, 5, 5])
            yield pd.DataFrame({"e": part["e"], "m": part["bucket"] * 12 + 6, "value": value})

    values = moments.mapInPandas(solve, "e bigint, m int, value double").where("NOT isnan(value)")
    return s.attach(hold(values, 12))


def _coskew(rows: DataFrame, months: int, least: int) -> DataFrame:
    """(e, m, value, n) over trailing months of rows (e, m, y, x): market moments over all rows, stock moments over valid ones.

    Centred moments are expanded into sums of powers of values that are first moved by the window-free entity mean, so
    one set of range frames is enough.
    """
    whole = W.partitionBy("e")
    rows = rows.withColumn("y", F.col("y") - F.avg("y").over(whole)).withColumn("x", F.col("x") - F.avg("x").over(whole))
    both = F.col("y").isNotNull() & F.col("x").isNotNull()
    y, x = F.when(both, F.col("y")), F.when(both, F.col("x"))
    sums = rows.groupBy("e", "m").agg(F.count("x").alias("nx"), F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"), F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x).alias("tx"), F.sum(x * x).alias("txx"), F.sum(y * x).alias("yx"), F.sum(y * x * x).alias("yxx"))
    frame = W.partitionBy("e").orderBy("m").rangeBetween(-(months - 1), 0)
    t = sums.select("e", "m", *(F.sum(c).over(frame).alias(c) for c in sums.columns[2:]))
    mx, my = F.col("sx") / F.col("nx"), F.col("sy") / F.col("n")
    t = t.withColumn("mx", mx).withColumn("my", my)
    mx, my = F.col("mx"), F.col("my")
    cross = F.col("yxx") - 2 * mx * F.col("yx") + mx * mx * F.col("sy") - my * (F.col("txx") - 2 * mx * F.col("tx") + mx * mx * F.col("n"))
    vy = F.col("syy") / F.col("n") - my * my
    vx = F.col("sxx") / F.col("nx") - mx * mx
    value = div(cross / F.col("n"), F.sqrt(vy) * vx)
    return t.where((F.col("n") >= least) & (vy > 1e-14) & (vx > 1e-14)).select("e", "m", "n", clean(value).alias("value"))


@operator
def coskew_signal(s: Stage, *children: Column, variant: str) -> Column:
    if variant == "monthly":
        rows = _stock_months(s).join(F.broadcast(s.table("factors_month").select("m", "mktrf", "rf")), "m")
        return s.attach(_coskew(rows.select("e", "m", (F.col("ret") - F.col("rf")).alias("y"), F.col("mktrf").alias("x")), 60, 12))
    rows = with_factors(s, days(s).where("d >= DATE'1962-07-02'"))
    logs = rows.select("e", "m", (ieee.log1p(F.col("ret")) - ieee.log1p(F.col("rf"))).alias("y"), (ieee.log1p(F.col("mktrf") + F.col("rf")) - ieee.log1p(F.col("rf"))).alias("x"))
    values = _coskew(logs.select("e", "m", ieee.finite(F.col("y")).alias("y"), ieee.finite(F.col("x")).alias("x")), 12, 1)
    most = values.groupBy("m").agg(F.max("n").alias("most"))
    return s.attach(values.join(F.broadcast(most), "m").where(F.col("most") - F.col("n") <= 5).select("e", "m", "value"))


def trailing_sums(rows: DataFrame, terms: dict[str, Column], order: str, windows: dict[str, int]) -> DataFrame:
    """Adds, for each term and window, the sum over an entity's last rows: a running sum less an earlier one.

    Missing terms count as 0.  Work does not grow with the windows, as it would with sliding frames.
    """
    along = W.partitionBy("e").orderBy(order)
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    running = rows.select("*", *(F.sum(F.coalesce(t, F.lit(0.0))).over(so_far).alias(f"_{n}") for n, t in terms.items()))
    past = lambda n, w: F.coalesce(F.lag(f"_{n}", w).over(along), F.lit(0.0))
    return running.select("*", *((F.col(f"_{n}") - past(n, w)).alias(f"{n}_{k}") for n in terms for k, w in windows.items())).drop(*(f"_{n}" for n in terms))


@operator
def betafp_signal(s: Stage, *children: Column) -> Column:
    """Correlation of three-day log returns over 1260 rows times the ratio of yearly volatilities."""
    rows = with_factors(s, days(s)).select("e", "m", "d", ieee.finite(ieee.log1p(F.col("ret"))).alias("y"), ieee.finite(ieee.log1p(F.col("mktrf"))).alias("x"))
    along = W.partitionBy("e").orderBy("d")
    three = lambda c: F.col(c) + F.lag(c, 1).over(along) + F.lag(c, 2).over(along)
    rows = rows.withColumn("y3", three("y")).withColumn("x3", three("x")).withColumn("xy", F.col("y3") * F.col("x3"))
    terms = {}
    for c in ("y", "x", "y3", "x3", "xy"):
        terms |= {f"n{c}": F.col(c).isNotNull().cast("double"), f"s{c}": F.col(c), f"q{c}": F.col(c) * F.col(c)}
    rows = trailing_sums(rows, terms, "d", {"year": 252, "long": 1260})
    mean = lambda c: F.when(F.col(f"n{c}_long") >= 500, F.col(f"s{c}_long") / F.col(f"n{c}_long"))

    def sd(c: str, window: str, least: int) -> Column:
        n, total, squares = (F.col(f"{k}{c}_{window}") for k in ("n", "s", "q"))
        return F.when(n >= least, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1)))

    # Step by step: a single expression holds each step several times, and the optimiser's copies of it fill the driver.
    rows = rows.select("e", "m", "d", *(mean(c).alias(f"m{c}") for c in ("xy", "x3", "y3")), *(sd(c, "long", 500).alias(f"d{c}") for c in ("x3", "y3")), *(sd(c, "year", 120).alias(f"d{c}") for c in ("y", "x")))
    rows = rows.select("e", "m", "d", (F.col("mxy") - F.col("mx3") * F.col("my3")).alias("cov"), (F.col("dx3") * F.col("dy3")).alias("sd"), div(F.col("dy"), F.col("dx")).alias("ratio"))
    rows = rows.withColumn("v", F.abs(div(F.col("cov"), F.col("sd"))) * F.col("ratio"))
    found = rows.groupBy("e", "m").agg(F.max_by("v", F.when(F.abs("v") < ieee.INF, F.col("d"))).alias("value"))
    return s.attach(found.where("value IS NOT NULL"))


def tail_series(rows: DataFrame, q: float = 0.05) -> DataFrame:
    """(m, tail): mean log excess over the lower quantile of a month's pooled returns, element floor(q (n - 1)).

    The quantile comes from counts of distinct values per month, so the window holds distinct values, not rows.
    """
    counts = rows.where("ret IS NOT NULL").groupBy("m", "ret").agg(F.count("*").alias("c"))
    total = counts.groupBy("m").agg(F.floor(F.lit(q) * (F.sum("c") - 1)).alias("rank"))
    placed = counts.withColumn("last", F.sum("c").over(W.partitionBy("m").orderBy("ret"))).join(F.broadcast(total), "m")
    edge = placed.where(F.col("last") > F.col("rank")).groupBy("m").agg(F.min("ret").alias("edge"))
    tail = counts.join(F.broadcast(edge), "m").where(F.col("ret") <= F.col("edge"))
    excess = ieee.finite(ieee.ln(div(F.col("ret"), F.col("edge"))))
    return tail.groupBy("m").agg((F.sum(excess * F.col("c")) / F.sum(F.when(excess.isNotNull(), F.col("c")))).alias("tail"))


@operator
def betatailrisk_signal(s: Stage, *children: Column, window: int = 120, min_obs: int = 72) -> Column:
    tail = tail_series(days(s).select("m", "ret"))
    listed = first_by(s.table("stock_month").select("e", "m", "ret", "shrcd"), ["e", "m"], "ret")
    valid = listed.join(F.broadcast(tail), "m").select("e", "m", F.col("ret").alias("y"), F.col("tail").alias("x")).dropna()
    frame = W.partitionBy("e").orderBy("m").rowsBetween(-(window - 1), 0)
    slope = F.when(F.count("y").over(frame) >= min_obs, F.regr_slope("y", "x").over(frame))
    value = _carried(s, listed, valid.select("e", "m", clean(slope).alias("value")))
    code = s.attach(listed.select("e", "m", F.col("shrcd").cast("double").alias("value")))
    return F.when(code <= 11, value)


# Rows of the moving averages.
TREND_WINDOWS = (3, 5, 10, 20, 50, 100, 200, 400, 600, 800, 1000)


def trailing_means(rows: DataFrame, value: str, order: str, windows: tuple[int, ...]) -> list[Column]:
    """Means of an entity's last rows, present values only, from running sums: work does not grow with the windows.

    A window that holds an infinity has an infinite mean, and a finite one again once it is past.
    """
    along = W.partitionBy("e").orderBy(order)
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    inner = {"_sum": F.sum(F.coalesce(finite(F.col(value)), F.lit(0.0))), "_n": F.count(value), "_inf": F.count(F.when(F.col(value) == ieee.INF, 1))}
    rows = rows.select("*", *(c.over(so_far).alias(n) for n, c in inner.items()))
    since = lambda c, w: F.col(c) - F.coalesce(F.lag(c, w).over(along), F.lit(0))
    means = [F.when(since("_inf", w) > 0, F.lit(ieee.INF)).otherwise(F.when(since("_n", w) > 0, since("_sum", w) / since("_n", w))) for w in windows]
    return rows.select("*", *(m.alias(f"a{w}") for m, w in zip(means, windows, strict=True))).drop(*inner)


def month_coefficients(moments: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Slopes of rows of moment triangles of (1, xs, y); collinear columns have slope 0, months without rows none.

    ``flat`` marks columns of one value.  The others, scaled to length one, are taken by pivoted Cholesky steps, largest
    rest first, until what is left is rounding; the fit on them is of least norm.
    """
    k = flat.shape[1]
    full = unfolded(moments, k + 2)
    out = np.full((len(full), k), np.nan)
    for r in np.flatnonzero(np.nan_to_num(full[:, 0, 0]) > 0):  # one row for each month
        use = np.flatnonzero(~flat[r])
        gram = full[r, 1:-1, 1:-1][np.ix_(use, use)]
        size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        rest = gram / np.outer(size, size)
        kept: list[int] = []
        while len(kept) < min(len(use), int(full[r, 0, 0])):
            j = int(np.argmax(np.diag(rest)))
            if rest[j, j] <= 1e-12:
                break
            kept.append(j)
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
            rest[j, :] = rest[:, j] = 0
        out[r] = 0
        if kept:
            own = [0, *(1 + use[sorted(kept)]), k + 1]
            flat_moments = full[r][np.ix_(own, own)][np.triu_indices(len(own))]
            out[r, use[sorted(kept)]] = solve_moments(flat_moments[None, :], len(kept), 0, least_norm=True)[0][0, 1:]
    return out


def _relative(mean: str) -> Column:
    """A mean over the row's own price; a finite mean over an infinite price is 0."""
    return F.when(F.col("p") == ieee.INF, F.when(F.col(mean) < ieee.INF, F.lit(0.0))).otherwise(div(F.col(mean), F.col("p")))


@operator
def trendfactor_signal(s: Stage, *children: Column, windows: tuple[int, ...] = TREND_WINDOWS) -> Column:
    """Return forecast from moving averages of price, with the mean of the twelve coefficient rows before.

    Missing prices and sizes count as +inf in the screens.  Next month's return must pass them as well.
    """
    rows = days(s).select("e", "m", "d", clean(div(F.abs("prc"), F.col("cfacpr"))).alias("p"))
    names = [f"a{w}" for w in windows]
    k = len(names)
    last = first_by(trailing_means(rows, "p", "d", windows), ["e", "m"], F.desc("d"))
    last = last.select("e", "m", *(_relative(n).alias(n) for n in names))
    u = s.table("universe").select("e", "m", "ret", "prc", "exchcd", "shrcd", "mve")
    sizes = u.where("exchcd = 1").groupBy("m").agg(F.sort_array(F.collect_list("mve")).alias("sizes"))
    edge = sizes.select("m", ranked_quantile(F.col("sizes"), 0.1).alias("p10"))
    top = lambda c: F.coalesce(c, F.lit(ieee.INF))
    passed = F.col("exchcd").isin(1, 2, 3) & F.col("shrcd").isin(10, 11) & (top(F.abs("prc")) >= 5) & (top(F.col("mve")) >= top(F.col("p10")))
    panel = u.join(F.broadcast(edge), "m", "left").where(passed).select("e", "m", "ret").join(last, ["e", "m"])
    panel = panel.withColumn("next", F.max("ret").over(W.partitionBy("e").orderBy("m").rangeBetween(1, 1)))
    xs = [finite(F.col(n)) for n in names]
    used = reduce(lambda a, b: a & b, [finite(F.col("next")).isNotNull(), *(x.isNotNull() for x in xs)])
    flat = [(F.min(F.when(used, x)) == F.max(F.when(used, x))).alias(f"f{i}") for i, x in enumerate(xs)]
    monthly = panel.groupBy("m").agg(*moment_columns(finite(F.col("next")), xs), *flat)
    columns = [f"m_{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            constant = part[[f"f{i}" for i in range(k)]].fillna(True).to_numpy(bool)
            slopes = month_coefficients(part[columns].to_numpy(float), constant)
            yield pd.DataFrame({"m": part["m"], **{f"b{i}": slopes[:, i] for i in range(k)}})

    fits = monthly.mapInPandas(solve, "m int, " + ", ".join(f"b{i} double" for i in range(k)))
    before = W.orderBy("m").rowsBetween(-12, -1)  # one row for each month
    expected = fits.select("m", *(F.avg(clean(F.col(f"b{i}"))).over(before).alias(f"e{i}") for i in range(k)))
    forecast = sum((F.col(f"e{i}") * F.col(n) for i, n in enumerate(names[1:], 1)), F.col("e0") * F.col(names[0]))
    return s.attach(as_value(panel.join(F.broadcast(expected), "m").select("e", "m", clean(forecast).alias("v")), "v"))


@operator
def announcement_return_signal(s: Stage, *children: Column, months: int = 6) -> Column:
    """Abnormal return from two rows before an announcement to one after, held for six months.

    Links are joined to announcements first (an interval join on the firm, so only few rows meet), then to the trading
    rows by an equi-join on entity and row number.
    """
    links = s.table("links").select("firm", "e", "first_day", F.coalesce("last_day", F.lit("2999-12-31").cast("date")).alias("last_day"))
    events = s.table("statement_quarter").where("rdq IS NOT NULL").select("firm", F.col("rdq").alias("day")).distinct()
    events = events.join(links, "firm").where(F.col("day").between(F.col("first_day"), F.col("last_day"))).select("e", "day").distinct()
    inside = s.table("stock_day").select("e", "d", "ret").join(links.select("e", "first_day", "last_day"), "e").where(F.col("d").between(F.col("first_day"), F.col("last_day"))).select("e", "d", "ret").distinct()
    rows = with_factors(s, inside).select("e", "d", (F.col("ret") - F.col("mktrf") - F.col("rf")).alias("x"))
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("e").orderBy("d")))
    found = rows.join(events, (rows["e"] == events["e"]) & (rows["d"] == events["day"])).select(rows["e"], "row")
    spread = found.withColumn("place", F.explode(F.array(*map(F.lit, (0, -1, -2, 1))))).withColumn("at", F.col("row") + F.col("place"))
    # A row that is near two announcements goes to the one whose window reaches it last: the day itself, the day before,
    # two days before, the day after.
    owner = first_by(spread.withColumn("turn", F.array_position(F.array(*map(F.lit, (0, -1, -2, 1))), F.col("place"))), ["e", "at"], F.desc("turn"), F.desc("row"))
    joined = rows.join(owner.select("e", F.col("at").alias("row"), F.col("row").alias("event")), ["e", "row"])
    sums = joined.groupBy("e", "event").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("v"), F.max("d").alias("d"))
    stamped = first_by(sums.withColumn("m", month_number("d")), ["e", "m"], F.desc("event")).select("e", "m", F.col("v").alias("value"))
    ends = stamped.groupBy("e").agg(F.max("m").alias("end"))
    return s.attach(hold(stamped, months + 1).join(ends, "e").where(F.col("m") <= F.col("end")).select("e", "m", "value"))


@operator
def high52_signal(s: Stage, *children: Column) -> Column:
    price = days(s).select("e", "m", "d", F.abs("prc").alias("x"))
    top = s.attach(monthly_statistic(price, "max"))
    last = s.attach(monthly_statistic(price.where("x IS NOT NULL"), "last"))
    return div(last, s.let(F.max(top).over(s.months(-12, -1))))


@operator
def zerotrade_signal(s: Stage, *children: Column, window: int, deflator: float) -> Column:
    """Days without trade plus a turnover tie-break, scaled to 21 days a month, of the months before."""
    rows = days(s)
    monthly = rows.groupBy("e", "m").agg(F.sum((F.col("vol") == 0).cast("double")).alias("zero"), F.sum(div(F.col("vol"), F.col("shrout"))).alias("turn"), F.count("*").cast("double").alias("days"))
    zero, turn, count = (s.attach(monthly.select("e", "m", F.col(c).alias("value"))) for c in ("zero", "turn", "days"))
    frame = s.months(-(window - 1), 0)
    whole = lambda x: s.let(F.when(F.count(x).over(frame) == window, F.sum(x).over(frame)))
    z, t, n = whole(zero), whole(turn), whole(count)
    value = s.let(div((z + div(div(F.lit(1.0), t), F.lit(float(deflator)))) * F.lit(21.0 * window), n))
    return F.when(count.isNotNull(), s.lag(value, 1))


@operator
def monthly_mean(s: Stage, *children: Column, table: str = "stock_day", column: str = "ret") -> Column:
    return s.attach(monthly_statistic(s.table(table).select("e", "d", month_number("d").alias("m"), F.col(column).alias("x")), "mean"))


@operator
def monthly_max(s: Stage, *children: Column, table: str = "stock_day", column: str = "ret") -> Column:
    return s.attach(monthly_statistic(s.table(table).select("e", "d", month_number("d").alias("m"), F.col(column).alias("x")), "max"))


@operator
def monthly_skew(s: Stage, *children: Column, table: str = "stock_day", column: str = "ret", min_obs: int = 15) -> Column:
    """Bias-adjusted, unlike the skewness of ``daily_monthly_stat``."""
    return s.attach(monthly_statistic(s.table(table).select("e", "d", month_number("d").alias("m"), F.col(column).alias("x")), "skew", min_obs, bias_adjusted=True))


@operator
def high_52(s: Stage, *children: Column) -> Column:
    return high52_signal(s)


# -- Liquidity innovations -------------------------------------------------------------------------------------------


def liquidity_gamma(s: Stage, least: int = 15) -> DataFrame:
    """(e, m, g): response of the next day's excess return to signed volume, over consecutive trading days of a month."""
    order = W.orderBy("d")  # one row for each trading day
    market = s.table("factors_day").select("d", (F.col("mktrf") + F.col("rf")).alias("mkt"), F.row_number().over(order).alias("pos"))
    rows = days(s).join(F.broadcast(market), "d").select("e", "m", "d", "pos", "ret", "mkt", "vol", F.abs("prc").alias("p"))
    along = W.partitionBy("e", "m").orderBy("d")
    rows = rows.select("*", F.lead("pos").over(along).alias("npos"), (F.lead("ret").over(along) - F.lead("mkt").over(along)).alias("y"))
    pairs = rows.where((F.col("npos") == F.col("pos") + 1) & (F.col("vol") > 0)).select("e", "m", "y", F.col("ret").alias("x0"), (F.signum(F.col("ret") - F.col("mkt")) * F.col("p") * F.col("vol") / 1e6).alias("x1"))
    fits = with_coefficients(pairs.groupBy("e", "m").agg(*moment_columns(F.col("y"), [F.col("x0"), F.col("x1")])), 2, least)
    return fits.select("e", "m", F.col("b2").alias("g")).where("g IS NOT NULL")


def liquidity_innovations(s: Stage, burn_in: int = 60, least: int = 15) -> DataFrame:
    """(m, ps_innov_pit): innovations of scaled liquidity, each from the months up to its own, never revised.

    Only monthly aggregates (a row for each month) are regressed; the expanding fits use cumulated moments.
    """
    before = s.table("universe").select("e", (F.col("m") + 1).alias("m"), "exchcd", "shrcd", F.abs("prc").alias("p"), "mve")
    kept = liquidity_gamma(s, least).join(before, ["e", "m"]).where(F.col("exchcd").isin(1, 2) & F.col("shrcd").isin(10, 11) & F.col("p").between(5, 1000))
    along = W.partitionBy("e").orderBy("m").rangeBetween(-1, -1)
    kept = kept.withColumn("dg", F.col("g") - F.max("g").over(along))
    monthly = kept.groupBy("m").agg(F.sum("mve").alias("cap"), F.avg("g").alias("level"), F.avg("dg").alias("change"))
    months = W.orderBy("m")  # one row for each month
    base = F.first("cap").over(months)
    scaled = monthly.select("m", (F.col("cap") / base * F.col("level")).alias("level"), (F.col("cap") / base * F.col("change")).alias("y"))
    lagged = scaled.select("m", "y", F.lag("y").over(months).alias("x0"), F.lag("level").over(months).alias("x1"))
    valid = lagged.dropna()
    past = months.rowsBetween(W.unboundedPreceding, 0)
    fits = with_coefficients(valid.select("*", *moment_columns(F.col("y"), [F.col("x0"), F.col("x1")], past)), 2, burn_in)
    innovation = F.col("y") - (F.col("b0") + F.col("b1") * F.col("x0") + F.col("b2") * F.col("x1"))
    return fits.select("m", innovation.alias("ps_innov_pit")).where("ps_innov_pit IS NOT NULL")


