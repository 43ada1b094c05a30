"""From factor and return tables to training rows: windows, screens, rank correlations, labels, fills and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.bins import average_rank
from cadenza.functions.ieee import clean, finite


def dates(returns: DataFrame) -> DataFrame:
    """(date, t): trading dates numbered from 0; one row for each date, so the ordering window is small."""
    return returns.select("date").distinct().withColumn("t", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))


def windows(returns: DataFrame, train: int = 120, test: int = 12, step: int = 12) -> DataFrame:
    """(window, date, role): rolling training dates and the test dates that follow."""
    d = dates(returns)
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    starts = d.crossJoin(n).where((F.col("t") % step == 0) & (F.col("t") + train < F.col("n"))).select((F.col("t") / step).cast("int").alias("window"), F.col("t").alias("start"))
    spread = starts.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("start") + train + test - 1)))
    role = F.when(F.col("t") < F.col("start") + train, F.lit("train")).otherwise(F.lit("test"))
    return spread.join(d, "t").select("window", "date", role.alias("role"))


def aligned_returns(returns: DataFrame, delay: int = 1) -> DataFrame:
    """(date, stock, ret): the return of ``delay`` trading dates later, on the signal's date."""
    d = F.broadcast(dates(returns))
    moved = returns.join(d, "date").select((F.col("t") - delay).alias("t"), "stock", "ret")
    return moved.join(d, "t").select("date", "stock", "ret")


def available_stocks(factors: DataFrame, returns: DataFrame, share_factors: float, share_dates: float, share_returns: float) -> DataFrame:
    """Stocks with enough factors that are present on enough dates, and with enough returns."""
    n_dates = F.broadcast(returns.agg(F.countDistinct("date").alias("n_dates")))
    n_factors = F.broadcast(factors.agg(F.countDistinct("factor").alias("n_factors")))
    per = factors.where(finite(F.col("value")).isNotNull()).groupBy("stock", "factor").agg(F.countDistinct("date").alias("k")).crossJoin(n_dates)
    enough = per.where(F.col("k") >= share_dates * F.col("n_dates")).groupBy("stock").agg(F.count("*").alias("good")).crossJoin(n_factors)
    kept = enough.where(F.col("good") >= share_factors * F.col("n_factors")).select("stock")
    valid = returns.where("ret IS NOT NULL").groupBy("stock").agg(F.count("*").alias("k")).crossJoin(n_dates).where(F.col("k") >= share_returns * F.col("n_dates"))
    return kept.join(valid.select("stock"), "stock")


def rank_correlations(factors: DataFrame, aligned: DataFrame, min_obs: int = 30) -> DataFrame:
    """(factor, date, ic): correlation of ranks, each side ranked over its own present values, on pairs of both.

    Returns are ranked once for each date, not once for each factor.
    """
    r = aligned.where("ret IS NOT NULL").select("date", "stock", average_rank(F.col("ret"), "date").alias("rr"))
    f = factors.where(finite(F.col("value")).isNotNull()).select("factor", "date", "stock", average_rank(F.col("value"), "factor", "date").alias("fr"))
    both = f.join(r, ["date", "stock"])
    ic = F.when((F.count("*") >= min_obs) & (F.min("fr") < F.max("fr")) & (F.min("rr") < F.max("rr")), F.corr("fr", "rr"))
    return both.groupBy("factor", "date").agg(clean(ic).alias("ic")).where("ic IS NOT NULL")


def factor_metrics(factors: DataFrame, aligned: DataFrame, min_obs: int = 30) -> DataFrame:
    """(factor, rank_ic, rank_ir): size of the mean correlation, and of its ratio to the deviation (0 if that is 0)."""
    ic = rank_correlations(factors, aligned, min_obs)
    sd = F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    return ic.groupBy("factor").agg(F.abs(F.avg("ic")).alias("rank_ic"), F.when(sd > 0, F.abs(F.avg("ic") / sd)).otherwise(F.lit(0.0)).alias("rank_ir"))


def select_factors(metrics: DataFrame, top: int | None = None, min_ic: float = 0.0, min_ir: float = 0.0) -> DataFrame:
    kept = metrics.where((F.col("rank_ic") >= min_ic) & (F.col("rank_ir") >= min_ir))
    return kept.orderBy(F.desc("rank_ic"), "factor").limit(top) if top is not None else kept


# -- Labels ------------------------------------------------------------------------------------------------------------


def future_return(returns: DataFrame, periods: int = 1, delay: int = 1) -> DataFrame:
    """(date, stock, label): compounded return over ``periods`` trading dates from ``delay`` on; all must be present."""
    d = F.broadcast(dates(returns))
    end = F.broadcast(d.agg(F.max("t").alias("end")))
    along = W.partitionBy("stock").orderBy("t").rangeBetween(delay, delay + periods - 1)
    rows = returns.join(d, "date").withColumn("label", F.when(F.count("ret").over(along) == periods, F.product(1 + F.col("ret")).over(along) - 1))
    return rows.crossJoin(end).where((F.col("t") + delay + periods - 1 <= F.col("end")) & F.col("label").isNotNull()).select("date", "stock", "label")


def future_spread(returns: DataFrame, periods: int = 1, delay: int = 1, benchmark: DataFrame | None = None) -> DataFrame:
    """The same less the compounded return of ``benchmark`` (date, ret), or else of the dates' equal-weight means."""
    means = returns.groupBy("date").agg(F.avg("ret").alias("ret")) if benchmark is None else benchmark.select("date", "ret")
    whole = dates(returns).select("date").join(means, "date", "left").select("date", F.lit(0).alias("stock"), "ret")
    market = future_return(whole, periods, delay).select("date", F.col("label").alias("market"))
    own = future_return(returns, periods, delay).join(F.broadcast(market), "date")
    return own.select("date", "stock", (F.col("label") - F.col("market")).alias("label"))


def current_return(returns: DataFrame, delay: int = 0) -> DataFrame:
    """(date, stock, label): the return of ``delay`` trading dates later."""
    return aligned_returns(returns, delay).where("ret IS NOT NULL").withColumnRenamed("ret", "label")


def valid_dates(factors: DataFrame, min_factors: int) -> DataFrame:
    """Dates on which at least so many factors have a value."""
    return factors.where("value IS NOT NULL").groupBy("date").agg(F.countDistinct("factor").alias("n")).where(F.col("n") >= min_factors).select("date")


# -- Fills and scaling -------------------------------------------------------------------------------------------------


def fill_median_by_date(factors: DataFrame) -> DataFrame:
    part = W.partitionBy("factor", "date")
    return factors.withColumn("value", F.coalesce(finite(F.col("value")), F.median(finite(F.col("value"))).over(part)))


def fill_median_by_stock(factors: DataFrame) -> DataFrame:
    part = W.partitionBy("factor", "stock")
    return factors.withColumn("value", F.coalesce(finite(F.col("value")), F.median(finite(F.col("value"))).over(part)))


def fill_from_training(test: DataFrame, train: DataFrame, by_stock: bool = True) -> DataFrame:
    """Missing test values: the stock's median in training (``by_stock``; the factor's, if it has none), the median of
    the date, which counts those just filled, and at last the factor's median in training.
    """
    every = F.broadcast(train.groupBy("factor").agg(F.median(finite(F.col("value"))).alias("every")))
    rows = test.withColumn("value", finite(F.col("value"))).join(every, "factor", "left")
    if by_stock:
        own = train.groupBy("factor", "stock").agg(F.median(finite(F.col("value"))).alias("own"), F.lit(True).alias("known"))
        rows = rows.join(own, ["factor", "stock"], "left").withColumn("value", F.coalesce("value", "own", F.when(F.col("known"), F.col("every")))).drop("own", "known")
    middle = F.median("value").over(W.partitionBy("factor", "date"))
    return rows.withColumn("value", F.coalesce("value", middle, "every")).select(*test.columns)


def fit_scale(train: DataFrame) -> DataFrame:
    """(factor, mean, sd): pooled over dates and stocks, finite values only; a deviation of 0 counts as 1."""
    value = finite(F.col("value"))
    sd = F.stddev_samp(value)
    return train.groupBy("factor").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"))


def apply_scale(rows: DataFrame, scale: DataFrame) -> DataFrame:
    joined = rows.join(F.broadcast(scale), "factor")
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def rank_transform(factors: DataFrame) -> DataFrame:
    """2 rank / (n + 1) - 1 for each factor and date, ties averaged."""
    n = F.count("value").over(W.partitionBy("factor", "date"))
    return factors.withColumn("value", 2 * average_rank(F.col("value"), "factor", "date") / (n + 1) - 1)


def training_rows(factors: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(date, stock, one column for each factor, label): rows in which everything is present and finite."""
    wide = factors.where(F.col("factor").isin(names)).groupBy("date", "stock").pivot("factor", names).agg(F.max(finite(F.col("value"))))
    return wide.join(labels.select("date", "stock", finite(F.col("label")).alias("label")), ["date", "stock"]).dropna()


def screen(scores: DataFrame, floors: dict[str, float], panels: dict[str, DataFrame]) -> DataFrame:
    """Rows whose screens are all present and at their floors."""
    for name, floor in floors.items():
        panel = panels[name].where(F.col("value") >= floor).select("date", "stock")
        scores = scores.join(panel, ["date", "stock"], "left_semi")
    return scores


def month_end_returns(daily: DataFrame) -> DataFrame:
    """(month, stock, ret) from (date, stock, ret): compounded; missing if any day of the month is."""
    whole = F.count("ret") == F.count(F.lit(1))
    value: Column = F.when(whole, F.product(1 + F.col("ret")) - 1)
    return daily.groupBy(F.trunc("date", "month").alias("month"), "stock").agg(value.alias("ret"))
