"""The walk-forward run against the same procedure on pandas panels, step by step."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.backtest import models, portfolio, run

DATES = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(40)]
STOCKS = list(range(1, 25))
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panels():
    rng = np.random.default_rng(11)
    f = {n: pd.DataFrame(rng.normal(size=(len(DATES), len(STOCKS))), DATES, STOCKS) for n in NAMES}
    ret = 0.02 * f["a"].shift(1).fillna(0) - 0.01 * f["b"].shift(1).fillna(0) + rng.normal(size=(len(DATES), len(STOCKS))) * 0.03
    for x in (*f.values(), ret):
        x.iloc[:, :] = np.where(rng.random(x.shape) < 0.12, np.nan, x)
    f["a"].iloc[:30, 3] = np.nan  # not valid in training
    f["c"].iloc[5, :20] = np.nan
    return f, ret


def tables(spark, panels):
    f, ret = panels
    long = [(n, d, s, float(v)) for n, x in f.items() for d, row in x.iterrows() for s, v in row.items() if not np.isnan(v)]
    factors = spark.createDataFrame(long, "factor STRING, date DATE, stock BIGINT, value DOUBLE")
    returns = spark.createDataFrame([(d, s, None if np.isnan(v) else float(v)) for d, row in ret.iterrows() for s, v in row.items()], "date DATE, stock BIGINT, ret DOUBLE")
    return factors, returns


def ranks(df):
    r = df.rank(axis=1)
    return 2 * r.div(r.notna().sum(axis=1) + 1, axis=0) - 1


def brute(f, ret, config):
    """(date, stock) -> score."""
    out = {}
    for at in range(0, len(DATES), config.test):
        if at + config.train >= len(DATES):
            break
        train, test = DATES[at : at + config.train], DATES[at + config.train : at + config.train + config.test]
        obs = train[:-1]
        aligned = ret.shift(-1).loc[obs]
        good = sum((f[n].loc[obs].notna().mean() >= config.stock_dates).astype(int) for n in NAMES)
        stocks = [s for s in STOCKS if good[s] >= config.stock_factors * 3 and aligned[s].notna().mean() >= config.stock_returns]
        chosen = sorted(n for n in NAMES if (f[n].loc[obs, stocks].notna().mean() >= config.factor_dates).mean() >= config.factor_stocks)
        if config.filters:
            ic = {}
            for n in chosen:
                x, y = f[n].loc[obs, stocks].rank(axis=1), aligned[stocks].rank(axis=1)
                ok = (x.notna() & y.notna()).sum(axis=1) >= config.min_ic_obs
                ic[n] = abs(x.corrwith(y, axis=1)[ok].dropna().mean())
            chosen = sorted(chosen, key=lambda n: (-ic[n], n))[: config.filters[0][2]]
        label = ret.shift(-1).loc[train, stocks]
        days = train[:-1]
        days = [d for d in days if sum(f[n].loc[d, stocks].notna().mean() >= config.date_stocks for n in chosen) >= config.date_factors * len(chosen)]
        xs, means, sds, every, own = {}, {}, {}, {}, {}
        for n in chosen:
            x = f[n].loc[days, stocks]
            every[n], own[n] = np.nanmedian(x.to_numpy()), x.median()
            x = x.T.fillna(x.median(axis=1)).T if config.fill == "date" else x.fillna(x.median())
            x = x.fillna(every[n])
            means[n], sds[n] = x.to_numpy().mean(), x.to_numpy().std(ddof=1)
            xs[n] = ranks(x) if config.scale == "rank" else (x - means[n]) / sds[n]
        big = np.column_stack([xs[n].to_numpy().ravel() for n in chosen])
        y = label.loc[days].to_numpy().ravel()
        keep = np.isfinite(y)
        big, y = big[keep], y[keep]
        mu = big.mean(axis=0)
        beta = np.linalg.solve((big - mu).T @ (big - mu) + np.eye(len(chosen)), (big - mu).T @ (y - y.mean()))
        for d in test:
            x = pd.DataFrame({n: f[n].loc[d] for n in chosen})
            x = x[x.notna().sum(axis=1) >= config.test_features * len(chosen)]
            if config.training_stocks_only:
                x = x[x.index.isin(stocks)]
            if config.fill == "stock":
                for n in chosen:
                    x[n] = x[n].fillna(own[n].fillna(every[n]).reindex(x.index))
            x = x.fillna(x.median()).fillna(pd.Series(every))
            x = ranks(x.T).T if config.scale == "rank" else (x - pd.Series(means)) / pd.Series(sds)
            for s, v in ((x[chosen] - mu) @ beta + y.mean()).items():
                out[d, s] = v
    return out


@pytest.mark.parametrize(
    "config",
    [
        run.Config(train=24, test=8, filters=(("rank_ic", None, 2),), stock_dates=0.7, stock_returns=0.7),
        run.Config(train=26, test=14, fill="stock", scale="pooled", training_stocks_only=True, date_stocks=0.75, date_factors=0.9),
    ],
)
def test_scores_equal_the_panel_procedure(spark, panels, config):
    got = {(r["date"], r["stock"]): r["score"] for r in run.scores(*tables(spark, panels), NAMES, config).collect()}
    want = brute(*panels, config)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_the_run_earns_what_its_factor_promises_and_is_kept(spark, panels, tmp_path):
    factors, returns = tables(spark, panels)
    result = run.run(factors, returns, NAMES, run.Config(train=24, test=16, picks=4, exchange=0.5, cost=0.001, floors={"c": -2.0}))
    assert result.performance.first()["total_return"] > 0
    weights = result.weights.groupBy("date").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).collect()
    assert all(r["net"] == pytest.approx(0) and r["gross"] == pytest.approx(2) for r in weights)
    assert result.book.agg(F.min("date")).first()[0] == DATES[25]  # the day after the first signal
    run.save(result, str(tmp_path))
    again = run.load(spark, str(tmp_path))
    assert again.scores.count() == result.scores.count()
    assert run.holdings(again, DATES[30]).groupBy("leg").count().collect()[0]["count"] == 4
    told = run.compare({"one": again, "two": again}, returns, min_obs=5).collect()
    assert {r["model"] for r in told} == {"one", "two"} and told[0]["rank_ic"] > 0.1


def test_without_valid_factors_there_is_no_window(spark, panels):
    factors, returns = tables(spark, panels)
    with pytest.raises(ValueError):
        run.scores(factors.where("value > 5"), returns, NAMES, run.Config(train=24, test=8))


def test_books_replace_missing_names_and_the_worst_besides(spark):
    d = DATES
    scores = [(d[0], s, float(20 - s)) for s in range(20)] + [(d[1], s, float(20 - s)) for s in range(20) if s != 1]
    got = portfolio.form_portfolio(spark.createDataFrame(scores, "date DATE, stock BIGINT, score DOUBLE"), 4, 0.25).collect()
    second = {r["stock"] for r in got if r["date"] == d[1] and r["w"] > 0}
    # 1 is missing and 3, the worst of those left, is dropped; the best that are not held come in, 3 again among them.
    assert second == {0, 2, 3, 4}


def test_smoothing_and_neutralising(spark):
    d = DATES
    scores = spark.createDataFrame([(d[0], 1, 1.0), (d[0], 2, 3.0), (d[1], 2, 5.0), (d[2], 1, 4.0)], "date DATE, stock BIGINT, score DOUBLE")
    got = {(r["date"], r["stock"]): r["score"] for r in portfolio.smooth(scores, 2).collect()}
    assert got == {(d[0], 1): 1.0, (d[1], 1): 1.0, (d[2], 1): 4.0, (d[0], 2): 3.0, (d[1], 2): 4.0, (d[2], 2): 5.0}
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=20), rng.normal(size=20)
    rows = spark.createDataFrame([(d[0], s, float(y[s])) for s in range(20)] + [(d[1], 1, 7.0)], "date DATE, stock BIGINT, score DOUBLE")
    styles = spark.createDataFrame([(d[0], s, float(x[s])) for s in range(18)] + [(d[1], 1, 1.0)], "date DATE, stock BIGINT, size DOUBLE")
    got = {(r["date"], r["stock"]): r["score"] for r in portfolio.neutralize(rows, styles, ["size"]).collect()}
    a, b = np.polyfit(x[:18], y[:18], 1)
    want = {(d[0], s): y[s] - a * x[s] - b for s in range(18)} | {(d[1], 1): 7.0}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_moment_matrix_adds_up_over_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "p DOUBLE, q DOUBLE, r DOUBLE").repartition(7)
    one = np.column_stack([np.ones(500), x])
    assert np.allclose(models.moment_matrix(df, ["p", "q", "r"]), one.T @ one)
