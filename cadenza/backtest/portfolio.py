"""From scores to performance: smoothing, neutralising, long-short books, drifted turnover and summary figures."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.backtest.prepare import dates
from cadenza.operators.regression import grouped_ols


def smooth(scores: DataFrame, periods: int) -> DataFrame:
    """Mean of a stock's scores on the last ``periods`` dates with scores; one that is missing on a date counts there too."""
    d = F.broadcast(dates(scores))
    end = F.broadcast(d.agg(F.max("t").alias("end")))
    placed = scores.join(d, "date").crossJoin(end)
    reached = placed.select("stock", F.explode(F.sequence("t", F.least(F.col("t") + periods - 1, "end"))).alias("t"), "score")
    return reached.groupBy("stock", "t").agg(F.avg("score").alias("score")).join(d, "t").select("date", "stock", "score").where("score IS NOT NULL")


def neutralize(scores: DataFrame, styles: DataFrame, names: list[str]) -> DataFrame:
    """Residuals of the scores on style columns (date, stock, names), for each date; stocks without styles drop out.

    Dates with fewer than two rows more than styles keep their scores.
    """
    rows = scores.where("score IS NOT NULL").join(styles.select("date", "stock", *names), ["date", "stock"], "left")
    fits = grouped_ols(rows, ["date"], "score", names, len(names) + 2, least_norm=True)
    joined = rows.join(F.broadcast(fits), "date")
    fitted = F.col("b0")
    for i, n in enumerate(names, 1):
        fitted = fitted + F.col(f"b{i}") * F.col(n)
    score = F.when(F.col("b0").isNull(), F.col("score")).otherwise(F.col("score") - fitted)
    return joined.select("date", "stock", score.alias("score")).where("score IS NOT NULL")


def _books(scored: pd.DataFrame, n: int, exchange: float) -> pd.DataFrame:
    """Weights along the dates; each date depends on the book of the date before."""
    out: list[tuple] = []
    longs: list = []
    shorts: list = []
    for date, day in scored.groupby("date", sort=True):
        ranked = day.sort_values(["score", "stock"], ascending=[False, True])["stock"].tolist()
        if len(ranked) >= 2 * n:
            place = {s: k for k, s in enumerate(ranked)}
            if not longs and not shorts:
                longs, shorts = ranked[:n], ranked[-n:]
            else:
                # Names without a score go, and the worst of the others besides.
                drop = min(n, math.ceil(exchange * n)) if exchange > 0 else 0
                keep_l = sorted((s for s in longs if s in place), key=place.__getitem__)
                keep_s = sorted((s for s in shorts if s in place), key=place.__getitem__, reverse=True)
                keep_l, keep_s = keep_l[: max(0, len(keep_l) - drop)], keep_s[: max(0, len(keep_s) - drop)]
                held = set(keep_l) | set(keep_s)
                longs = keep_l + [s for s in ranked if s not in held][: n - len(keep_l)]
                held |= set(longs)
                shorts = keep_s + [s for s in reversed(ranked) if s not in held][: n - len(keep_s)]
        out += [(date, s, 1 / len(longs)) for s in longs] + [(date, s, -1 / len(shorts)) for s in shorts]
    return pd.DataFrame(out, columns=["date", "stock", "w"])


def form_portfolio(scores: DataFrame, n: int, exchange: float = 1.0) -> DataFrame:
    """(date, stock, w): equal-weight books of n longs and n shorts, of which a share is exchanged at each date.

    Books depend on the dates before, so dates run in order in one task; what it gets is bounded by the names that can
    enter a book: on each date the best and worst ``3 n`` and the names that are in them on some date.
    """
    best = F.row_number().over(W.partitionBy("date").orderBy(F.desc("score"), "stock"))
    worst = F.row_number().over(W.partitionBy("date").orderBy(F.asc("score"), F.desc("stock")))
    ranked = scores.where("score IS NOT NULL").withColumn("b", best).withColumn("v", worst)
    edge = ranked.where((F.col("b") <= 3 * n) | (F.col("v") <= 3 * n))
    rows = ranked.join(F.broadcast(edge.select("stock").distinct()), "stock", "left_semi").select("date", "stock", "score", F.lit(1).alias("one"))
    kind = rows.schema["stock"].dataType.simpleString()
    when = rows.schema["date"].dataType.simpleString()
    return rows.groupBy("one").applyInPandas(lambda df: _books(df, n, exchange), f"date {when}, stock {kind}, w double")


def shift_to_execution(weights: DataFrame, returns: DataFrame, delay: int = 1) -> DataFrame:
    """Weights moved from the signal's date to the trading date ``delay`` later."""
    d = F.broadcast(dates(returns))
    moved = weights.join(d, "date").select((F.col("t") + delay).alias("t"), "stock", "w")
    return moved.join(d, "t").select("date", "stock", "w")


def accounting(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, gross, turnover): returns of drifted weights, and one-way turnover at each rebalancing.

    Between rebalancings the value of the book is V = 1 + sum w (G - 1) with G the stock's growth since, so every date is
    a sum over stocks: no loop over dates is needed.  A missing return counts as 0.
    """
    d = dates(returns)
    rebalanced = weights.select("date").distinct()
    since = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # one row for each date
    grid = d.join(rebalanced.withColumn("is_new", F.lit(True)), "date", "left").withColumn("book", F.last(F.when(F.col("is_new"), F.col("t")), True).over(since)).where("book IS NOT NULL")
    grid = F.broadcast(grid.select("date", "t", "book", F.coalesce("is_new", F.lit(False)).alias("is_new")))
    held = weights.join(grid.where("is_new").select(F.col("date"), F.col("t").alias("book")), "date").select("stock", "book", "w")
    rows = held.join(grid.select("date", "t", "book"), "book").join(returns.select("date", "stock", F.coalesce("ret", F.lit(0.0)).alias("ret")), ["date", "stock"], "left")
    along = W.partitionBy("stock", "book").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("growth", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(along))
    value = rows.groupBy("book", "t", "date").agg((1 + F.sum(F.col("w") * (F.col("growth") - 1))).alias("value"))
    along_book = W.partitionBy("book").orderBy("t")
    gross = value.withColumn("gross", F.col("value") / F.coalesce(F.lag("value").over(along_book), F.lit(1.0)) - 1)
    # Drifted weights at the end of each book's life, against the targets of the next book.
    last = value.groupBy("book").agg(F.max("t").alias("t"))
    drifted = rows.join(last, ["book", "t"]).join(value.select("book", "t", "value"), ["book", "t"]).select((F.col("t") + 1).alias("book"), "stock", (F.col("w") * F.col("growth") / F.col("value")).alias("was"))
    first = F.broadcast(held.agg(F.min("book").alias("first")))
    target = held.select("book", "stock", "w")
    moved = target.join(drifted, ["book", "stock"], "full_outer").crossJoin(first)
    books = held.select("book").distinct()
    traded = moved.join(books, "book", "left_semi").groupBy("book").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("turnover"))
    return gross.join(traded.withColumnRenamed("book", "t"), "t", "left").select("date", "gross", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def legs(weights: DataFrame) -> DataFrame:
    """(leg, date, stock, w): long and short sides scaled to gross one each, and both together."""
    part = W.partitionBy("date")
    side = lambda c: F.abs(F.sum(F.when(c, F.col("w"))).over(part))
    long = weights.withColumn("g", side(F.col("w") > 0)).where("w > 0").select(F.lit("long").alias("leg"), "date", "stock", (F.col("w") / F.col("g")).alias("w"))
    short = weights.withColumn("g", side(F.col("w") < 0)).where("w < 0").select(F.lit("short").alias("leg"), "date", "stock", (F.col("w") / F.col("g")).alias("w"))
    whole = weights.withColumn("g", F.sum(F.abs("w")).over(part)).select(F.lit("long_short").alias("leg"), "date", "stock", (F.col("w") / F.col("g")).alias("w"))
    return long.unionByName(short).unionByName(whole)


def performance(book: DataFrame, rate: float = 0.0, periods_per_year: int = 12, by_year: bool = False) -> DataFrame:
    """Figures of (date, gross, turnover): net return, annual return, Sharpe ratio, volatility, greatest drawdown.

    One row for each date is all that is ordered here.
    """
    keys = [F.year("date").alias("year")] if by_year else [F.lit("all").alias("year")]
    rows = book.select("date", *keys, (F.col("gross") - rate * F.col("turnover")).alias("net"), "turnover")
    along = W.partitionBy("year").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("value", F.product(1 + F.col("net")).over(along)).withColumn("peak", F.greatest(F.max("value").over(along), F.lit(1.0)))
    n, sd = F.count("*"), F.coalesce(F.stddev_samp("net"), F.lit(0.0))
    total = F.product(1 + F.col("net"))
    return rows.groupBy("year").agg(
        n.alias("periods"),
        (total - 1).alias("total_return"),
        (F.pow(total, F.lit(float(periods_per_year)) / n) - 1).alias("annual_return"),
        (sd * math.sqrt(periods_per_year)).alias("volatility"),
        F.when(sd > 0, F.avg("net") / sd * math.sqrt(periods_per_year)).otherwise(F.lit(0.0)).alias("sharpe"),
        F.min(F.col("value") / F.col("peak") - 1).alias("max_drawdown"),
        F.avg("turnover").alias("mean_turnover"),
    )


def drawdowns(book: DataFrame) -> DataFrame:
    """(date, drawdown) of (date, gross) against the running peak, which starts at 1."""
    along = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = book.withColumn("value", F.product(1 + F.col("gross")).over(along)).withColumn("peak", F.greatest(F.max("value").over(along), F.lit(1.0)))
    return rows.select("date", (F.col("value") / F.col("peak") - 1).alias("drawdown"))
