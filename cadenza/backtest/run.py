"""The walk-forward run: windows, screens, selection, fills, a model for each window, a book, and its figures.

Factors come long and are turned once into one row for each date and stock with a column for each factor.  Within a
window, everything is an expression over those columns or a small aggregate (a row for each date, stock or factor) that
is joined back.  Stocks and scores of a window, the book and its weights are written to the shared folder, so plans stay
small however many windows there are.  The loop over windows is the driver's: there are as many as
the dates allow, whatever the number of stocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.backtest import models, portfolio, prepare
from cadenza.functions.bins import average_rank
from cadenza.functions.ieee import finite
from cadenza.sources.sinks import written


@dataclass
class Config:
    """Settings of a run; shares are of the dates, stocks or factors of a training window."""

    train: int = 120
    test: int = 12
    delay: int = 1
    stock_dates: float = 0.6  # a factor counts for a stock if present on this share of dates,
    stock_factors: float = 0.6  # a stock is in if this share of factors counts
    stock_returns: float = 0.6  # and this share of its returns is present
    factor_dates: float = 0.5  # a factor is in if, for ``factor_stocks`` of the stocks, it is present on this share of dates
    factor_stocks: float = 0.5
    filters: tuple[tuple[str, float | None, int | None], ...] = ()  # (metric, least value, most factors), in this order
    min_ic_obs: int = 5
    label: str = "future_return"
    periods: int = 1
    date_stocks: float = 0.5  # a date is trained on if this share of factors is present for
    date_factors: float = 0.5  # this share of stocks
    fill: str | None = "date"  # date, stock or None
    scale: str | None = "rank"  # rank, pooled or None
    model: Callable[[], Any] = models.Ridge
    test_features: float = 0.5  # a test row needs this share of the selected factors
    training_stocks_only: bool = False
    floors: dict[str, float] = field(default_factory=dict)
    smooth: int = 1
    styles: tuple[str, ...] = ()
    picks: int = 50
    exchange: float = 1.0
    cost: float = 0.0
    periods_per_year: int = 12


def wide_factors(factors: DataFrame, names: list[str]) -> DataFrame:
    """(date, stock, one finite column for each factor)."""
    return factors.where(F.col("factor").isin(names)).groupBy("date", "stock").pivot("factor", names).agg(F.max(finite(F.col("value"))))


def _share(condition: Column, total: int) -> Column:
    return F.sum(condition.cast("int")) / F.lit(total)


def training_stocks(rows: DataFrame, names: list[str], config: Config, n_dates: int) -> DataFrame:
    """Stocks of (date, stock, factors, ret), which holds the observable dates and the returns aligned with them."""
    share = {n: _share(F.col(n).isNotNull(), n_dates) for n in names}
    counts = rows.groupBy("stock").agg(*(v.alias(n) for n, v in share.items()), _share(F.col("ret").isNotNull(), n_dates).alias("_ret"))
    good = reduce(lambda a, b: a + b, [(F.col(n) >= config.stock_dates).cast("int") for n in names])
    return counts.where((good >= config.stock_factors * len(names)) & (F.col("_ret") >= config.stock_returns)).select("stock")


def selected_factors(rows: DataFrame, names: list[str], config: Config, n_dates: int, n_stocks: int) -> list[str]:
    """Factors that are valid for enough stocks and pass the filters in turn; ties go by name."""
    per_stock = rows.groupBy("stock").agg(*(_share(F.col(n).isNotNull(), n_dates).alias(n) for n in names))
    valid = per_stock.agg(*(_share(F.col(n) >= config.factor_dates, n_stocks).alias(n) for n in names)).first()
    kept = sorted(n for n in names if valid[n] is not None and valid[n] >= config.factor_stocks)
    if not kept or not config.filters:
        return kept
    long = rows.select("date", "stock", *kept).unpivot(["date", "stock"], kept, "factor", "value")
    metrics = {r["factor"]: r for r in prepare.factor_metrics(long, rows.select("date", "stock", "ret"), config.min_ic_obs).collect()}
    kept = [n for n in kept if n in metrics]
    for metric, least, most in config.filters:
        if least is not None:
            kept = [n for n in kept if metrics[n][metric] >= least]
        if most is not None:
            kept = sorted(kept, key=lambda n: (-metrics[n][metric], n))[:most]
    return kept


def _labels(returns: DataFrame, config: Config) -> tuple[DataFrame, int]:
    """Labels of all dates, and the number of dates that they look ahead."""
    if config.label == "current_return":
        return prepare.current_return(returns, config.delay), config.delay
    make = {"future_return": prepare.future_return, "future_spread": prepare.future_spread}[config.label]
    return make(returns, config.periods, config.delay), config.delay + config.periods - 1


def _ranks(rows: DataFrame, names: list[str]) -> DataFrame:
    n = {c: F.count(c).over(W.partitionBy("date")) for c in names}
    keep = [c for c in rows.columns if c not in names]
    return rows.select(*keep, *((2 * average_rank(F.col(c), "date") / (n[c] + 1) - 1).alias(c) for c in names))


def _medians(rows: DataFrame, names: list[str], *keys: str, suffix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.median(c).alias(c + suffix) for c in names))


def _filled(rows: DataFrame, names: list[str], *suffixes: str) -> DataFrame:
    keep = [c for c in rows.columns if c not in names and not c.endswith(suffixes)]
    return rows.select(*keep, *(F.coalesce(c, *(c + s for s in suffixes)).alias(c) for c in names))


def window_scores(wide: DataFrame, returns: DataFrame, names: list[str], train: list, test: list, config: Config) -> DataFrame | None:
    """(date, stock, score) of one window's test dates; None if nothing passes its screens."""
    spark = wide.sparkSession
    ahead = {d: k for k, d in enumerate(train)}
    observable = train[: len(train) - config.delay]
    dated = lambda days: F.broadcast(spark.createDataFrame([(d,) for d in days], "date date"))
    returned = returns.select("stock").distinct()
    everything = returned.crossJoin(dated(train)).join(wide, ["date", "stock"], "left")
    aligned = prepare.aligned_returns(returns, config.delay)
    seen = everything.join(dated(observable), "date").join(aligned, ["date", "stock"], "left")
    stocks = written(training_stocks(seen, names, config, len(observable)), "run-stocks")
    n_stocks = stocks.count()
    if not n_stocks:
        return None
    chosen = selected_factors(seen.join(stocks, "stock"), names, config, len(observable), n_stocks)
    if not chosen:
        return None
    labels, horizon = _labels(returns, config)
    usable = [d for d in train if ahead[d] < len(train) - horizon]
    rows = everything.select("date", "stock", *chosen).join(stocks, "stock").join(dated(usable), "date")
    whole = reduce(lambda a, b: a + b, [(_share(F.col(n).isNotNull(), n_stocks) >= config.date_stocks).cast("int") for n in chosen])
    days = F.broadcast(rows.groupBy("date").agg(whole.alias("n")).where(F.col("n") >= config.date_factors * len(chosen)).select("date"))
    rows = rows.join(days, "date")
    every = F.broadcast(_medians(rows, chosen, suffix="__all"))
    own = _medians(rows, chosen, "stock", suffix="__own") if config.fill == "stock" else None
    if config.fill == "date":
        rows = _filled(rows.join(F.broadcast(_medians(rows, chosen, "date", suffix="__day")), "date").crossJoin(every), chosen, "__day", "__all")
    elif own is not None:
        rows = _filled(rows.join(own, "stock").crossJoin(every), chosen, "__own", "__all")
    scale = None
    if config.scale == "rank":
        rows = _ranks(rows, chosen)
    elif config.scale == "pooled":
        sd = lambda c: F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)).otherwise(F.lit(1.0))
        scale = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m_{c}") for c in chosen), *(sd(c).alias(f"s_{c}") for c in chosen)).first()
    scaled = lambda df: df if scale is None else df.select(*(c for c in df.columns if c not in chosen), *(((F.col(c) - scale[f"m_{c}"]) / scale[f"s_{c}"]).alias(c) for c in chosen))
    training = scaled(rows).join(labels.withColumn("label", finite(F.col("label"))), ["date", "stock"]).dropna()
    model = config.model().fit(training.select("date", "stock", *chosen, "label"), chosen)

    rows = wide.join(dated(test), "date")
    if config.training_stocks_only:
        rows = rows.join(stocks, "stock", "left_semi")
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in chosen])
    passed = reduce(lambda a, b: a & b, [F.col(c) >= floor for c, floor in config.floors.items()], present >= config.test_features * len(chosen))
    rows = rows.where(passed).select("date", "stock", *chosen)
    if own is not None:
        known = own.crossJoin(every)
        known = known.select("stock", *(F.coalesce(f"{c}__own", f"{c}__all").alias(f"{c}__own") for c in chosen))
        rows = _filled(rows.join(known, "stock", "left"), chosen, "__own")
    if config.fill:
        day = F.broadcast(_medians(rows, chosen, "date", suffix="__day"))
        rows = _filled(rows.join(day, "date").crossJoin(every), chosen, "__day", "__all")
    rows = rows.dropna()
    rows = _ranks(rows, chosen) if config.scale == "rank" else scaled(rows)
    return model.predict(rows).select("date", "stock", "score")


def scores(factors: DataFrame, returns: DataFrame, names: list[str], config: Config) -> DataFrame:
    """Out-of-sample scores of all windows, one after the other."""
    # One row for each trading date is all that the driver sees.
    days = [r["date"] for r in prepare.dates(returns).orderBy("t").collect()]
    wide = written(wide_factors(factors, sorted({*names, *config.floors})), "run-factors")
    returns = written(returns.select("date", "stock", "ret"), "run-returns")
    found = []
    for at in range(0, len(days), config.test):
        if at + config.train >= len(days):
            break
        train, test = days[at : at + config.train], days[at + config.train : at + config.train + config.test]
        if (own := window_scores(wide, returns, names, train, test, config)) is not None:
            found.append(written(own, "run-scores"))
    if not found:
        raise ValueError("no window has training rows")
    return reduce(DataFrame.unionByName, found)


def adjusted(scored: DataFrame, factors: DataFrame, config: Config) -> DataFrame:
    if config.smooth > 1:
        scored = portfolio.smooth(scored, config.smooth)
    if config.styles:
        scored = portfolio.neutralize(scored, wide_factors(factors, list(config.styles)), list(config.styles))
    return scored


@dataclass
class Result:
    scores: DataFrame
    weights: DataFrame
    book: DataFrame  # (date, gross, turnover)
    performance: DataFrame
    yearly: DataFrame


def run(factors: DataFrame, returns: DataFrame, names: list[str], config: Config) -> Result:
    """Scores, signal weights, the book on trading dates, and its figures."""
    scored = written(adjusted(scores(factors, returns, names, config), factors, config), "run-adjusted")
    weights = written(portfolio.form_portfolio(scored, config.picks, config.exchange), "run-weights")
    book = written(portfolio.accounting(portfolio.shift_to_execution(weights, returns, config.delay), returns), "run-book")
    figures = lambda by_year: portfolio.performance(book, config.cost, config.periods_per_year, by_year)
    return Result(scored, weights, book, figures(False), figures(True))


def save(result: Result, root: str) -> None:
    """The artefacts of a run, one table each, below ``root``."""
    for name in ("scores", "weights", "book", "performance", "yearly"):
        getattr(result, name).write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: Any, root: str) -> Result:
    return Result(*(spark.read.parquet(f"{root}/{name}") for name in ("scores", "weights", "book", "performance", "yearly")))


def holdings(result: Result, date: Any) -> DataFrame:
    """(leg, stock, w) of the newest book that was formed by ``date``."""
    formed = result.weights.where(F.col("date") <= F.lit(date))
    newest = F.broadcast(formed.agg(F.max("date").alias("date")))
    return formed.join(newest, "date").select(F.when(F.col("w") > 0, "long").otherwise("short").alias("leg"), "stock", "w")


def compare(results: dict[str, Result], returns: DataFrame, delay: int = 1, min_obs: int = 30) -> DataFrame:
    """One row for each model: mean out-of-sample rank correlation, its ratio to the deviation, and the figures."""
    aligned = prepare.aligned_returns(returns, delay)
    rows = []
    for name, result in results.items():
        ic = prepare.rank_correlations(result.scores.select("date", "stock", F.lit(name).alias("factor"), F.col("score").alias("value")), aligned, min_obs)
        told = ic.agg(F.avg("ic").alias("rank_ic"), (F.avg("ic") / F.stddev_samp("ic")).alias("rank_ir"), F.count("*").alias("n_dates"))
        rows.append(told.crossJoin(result.performance.drop("year")).select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, rows)
