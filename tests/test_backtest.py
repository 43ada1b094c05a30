"""Small hand-computed cases of the evaluation layers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import validation
from cadenza.backtest import models, portfolio, prepare
from cadenza.oracles import evaluation
from cadenza.plans import manifest
from cadenza.plans.compiler import Library
from cadenza.plans.expr import V, parse


def day(k):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=31 * k)


def returns(spark, rows):
    return spark.createDataFrame([(day(t), s, r) for t, s, r in rows], "date DATE, stock BIGINT, ret DOUBLE")


def test_turnover_counts_drift(spark):
    r = returns(spark, [(0, 1, 0.10), (0, 2, 0.0), (1, 1, 0.0), (1, 2, 0.0)])
    w = spark.createDataFrame([(day(t), s, x) for t in (0, 1) for s, x in ((1, 0.5), (2, -0.5))], "date DATE, stock BIGINT, w DOUBLE")
    got = portfolio.accounting(w, r).orderBy("date").collect()
    assert got[0]["gross"] == pytest.approx(0.05)
    assert got[1]["turnover"] == pytest.approx((abs(0.5 - 0.5 * 1.10 / 1.05) + abs(-0.5 + 0.5 / 1.05)) / 2)


def test_gap_months_are_held_without_turnover(spark):
    r = returns(spark, [(t, s, x) for t, pair in enumerate([(0.02, 0.0), (0.03, -0.05), (0.30, -0.10), (0.20, 0.0), (0.01, 0.02)]) for s, x in zip((1, 2), pair, strict=True)])
    w = spark.createDataFrame([(day(t), s, x) for t, pair in ((0, (0.6, 0.4)), (1, (0.6, 0.4)), (4, (0.5, 0.5))) for s, x in zip((1, 2), pair, strict=True)], "date DATE, stock BIGINT, w DOUBLE")
    got = portfolio.accounting(w, r).orderBy("date").collect()
    assert [x["turnover"] for x in got][2:4] == [0.0, 0.0]
    a, b = 0.6 * 1.03, 0.4 * 0.95
    assert got[2]["gross"] == pytest.approx((a * 1.3 + b * 0.9) / (a + b) - 1)
    a, b = a * 1.3 * 1.2, b * 0.9
    assert got[4]["turnover"] == pytest.approx(abs(0.5 - a / (a + b)) / 2 + abs(0.5 - b / (a + b)) / 2)


def test_drawdown_starts_from_one(spark):
    book = spark.createDataFrame([(day(0), -0.10), (day(1), 0.05)], "date DATE, gross DOUBLE")
    assert [r["drawdown"] for r in portfolio.drawdowns(book).orderBy("date").collect()] == pytest.approx([-0.10, -0.055])


def test_month_returns_need_every_day(spark):
    rows = [(datetime.date(2020, 1, 2), 1, 0.10), (datetime.date(2020, 1, 3), 1, 0.0), (datetime.date(2020, 2, 3), 1, 0.05), (datetime.date(2020, 2, 4), 1, -0.02), (datetime.date(2020, 1, 2), 2, 0.03), (datetime.date(2020, 1, 3), 2, None), (datetime.date(2020, 2, 3), 2, 0.04)]
    got = {(r["month"].month, r["stock"]): r["ret"] for r in prepare.month_end_returns(spark.createDataFrame(rows, "date DATE, stock BIGINT, ret DOUBLE")).collect()}
    assert got[1, 1] == pytest.approx(0.10) and got[2, 1] == pytest.approx(1.05 * 0.98 - 1) and got[1, 2] is None and got[2, 2] == pytest.approx(0.04)


def test_neutral_scores_lack_uncovered_stocks(spark):
    scores = spark.createDataFrame([(day(0), k, float(v)) for k, v in enumerate([10, 20, 30, 40, 50, 999], 1)], "date DATE, stock BIGINT, score DOUBLE")
    styles = spark.createDataFrame([(day(0), k, float(k * k)) for k in range(1, 6)] + [(day(0), 6, None)], "date DATE, stock BIGINT, size DOUBLE")
    got = portfolio.neutralize(scores, styles, ["size"]).collect()
    assert {r["stock"] for r in got} == {1, 2, 3, 4, 5} and sum(r["score"] for r in got) == pytest.approx(0, abs=1e-9)


def test_rank_transform(spark):
    rows = [("f", day(0), k, v) for k, v in enumerate([10.0, 20.0, 30.0, None])] + [("f", day(1), k, v) for k, v in enumerate([5.0, 1.0, 3.0, 2.0])]
    got = prepare.rank_transform(spark.createDataFrame(rows, "factor STRING, date DATE, stock BIGINT, value DOUBLE")).orderBy("date", "stock").collect()
    assert [r["value"] for r in got] == pytest.approx([-0.5, 0.0, 0.5, None, 0.6, -0.6, 0.2, -0.2])


def test_labels_pair_with_later_returns(spark):
    r = returns(spark, [(t, 1, 0.01 * t) for t in range(5)])
    got = {x["date"]: x["label"] for x in prepare.future_return(r, 1, 1).collect()}
    assert got == {day(t): pytest.approx(0.01 * (t + 1)) for t in range(4)}


def test_good_factor_beats_noise(spark):
    rng = np.random.default_rng(0)
    quality = [rng.permutation(40) for _ in range(6)]
    f = [("quality", day(t), s, float(q[s])) for t, q in enumerate(quality) for s in range(40)] + [("noise", day(t), s, float(x)) for t in range(6) for s, x in enumerate(rng.permutation(40))]
    aligned = spark.createDataFrame([(day(t), s, float(q[s] - 19.5) / 100) for t, q in enumerate(quality) for s in range(40)], "date DATE, stock BIGINT, ret DOUBLE")
    m = {r["factor"]: r["rank_ic"] for r in prepare.factor_metrics(spark.createDataFrame(f, "factor STRING, date DATE, stock BIGINT, value DOUBLE"), aligned, 10).collect()}
    assert m["quality"] == pytest.approx(1.0) and m["noise"] < 0.5


@pytest.mark.parametrize("model", [models.Ridge(0.1), models.Perceptron(epochs=20, rate=3e-3)])
def test_models_learn_a_linear_rule(spark, model):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=1500) * 0.05
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "stock BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, label DOUBLE")
    with pytest.raises(RuntimeError):
        type(model)().predict(df)
    with pytest.raises(ValueError):
        type(model)().fit(df.limit(0), ["a", "b", "c"])
    got = model.fit(df, ["a", "b", "c"]).predict(df).select(F.corr("score", "label")).first()[0]
    assert got > 0.95


def test_portfolio_replaces_the_worst(spark):
    scores = [(day(0), s, float(10 - s)) for s in range(8)] + [(day(1), s, float(v)) for s, v in enumerate([1, 9, 8, 7, 6, 5, 4, 0])]
    got = portfolio.form_portfolio(spark.createDataFrame(scores, "date DATE, stock BIGINT, score DOUBLE"), 2, 0.5).collect()
    first = {r["stock"]: r["w"] for r in got if r["date"] == day(0)}
    second = {r["stock"]: r["w"] for r in got if r["date"] == day(1)}
    assert first == {0: 0.5, 1: 0.5, 6: -0.5, 7: -0.5}
    assert second == {1: 0.5, 2: 0.5, 7: -0.5, 0: -0.5}


def test_panels_compare_masks_and_infinities(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("inf")), (1, 3, None), (1, 4, 2.0)], "e BIGINT, m INT, value DOUBLE")
    b = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("inf")), (1, 3, 5.0), (1, 4, 2.5)], "e BIGINT, m INT, value DOUBLE")
    r = validation.diff_panels(a, b).first()
    assert (r["both"], r["left_only"], r["right_only"], r["differing"], r["equal"]) == (3, 0, 1, 1, False)
    assert validation.worst_cells(a, b).first()["m"] == 3
    assert validation.schema_changes(a, b.withColumn("x", F.lit(1))) == ["+ x int"]


def test_incremental_build_skips_what_has_not_changed(spark, tmp_path):
    tables = {
        "stock_month": spark.createDataFrame([(1, 24000 + k, 10.0, 11.0, 1.0 + k) for k in range(3)], "e BIGINT, m INT, shrcd DOUBLE, exchcd DOUBLE, prc DOUBLE").withColumn("exchcd", F.lit(1.0)),
        "statement_month": spark.createDataFrame([], "e BIGINT, m INT"),
        "universe": spark.createDataFrame([], "e BIGINT, m INT, firm BIGINT, ticker STRING"),
    }
    (tmp_path / "in.txt").write_text("x")
    trees = {"P": parse("abs(C.prc)", {}, {"C": "stock_month"}), "bad": V("nowhere", "x")}
    library = Library(lambda n: tables[n])
    args = (library, spark, trees, str(tmp_path / "out"), [str(tmp_path / "in.txt")])
    first = manifest.build(*args, log=lambda x: None)
    assert first["P"] == "built" and first["bad"].startswith("failed")
    assert manifest.waves({"P": trees["P"], "Q": parse("abs(C.prc) + 1", {}, {"C": "stock_month"}), "R": parse("abs(C.prc)[t-1]", {}, {"C": "stock_month"})}, 2) == [["P", "R"], ["Q"]]
    assert manifest.build(*args, log=lambda x: None)["P"] == "current"
    assert sorted(r["value"] for r in manifest.read_factors(spark, str(tmp_path / "out")).collect()) == [1.0, 2.0, 3.0]


def test_queries_take_every_stock_and_every_window(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(day(t), s, *map(float, rng.normal(size=4) * 0.05)) for t in range(63) for s in range(1, 9)]
    table = spark.createDataFrame(rows, "date DATE, stock BIGINT, ret DOUBLE, mve_c DOUBLE, prc DOUBLE, vol DOUBLE").cache()
    monkeypatch.setattr(evaluation, "returns", lambda s, d: table)
    ret = {(r[0], r[1]): r[2] for r in rows}
    got = {(r["date"], r["stock"]): r["w"] for r in evaluation._book(spark, "").collect()}
    assert got == {(day(t), s): (1 if s % 2 == 0 else -1) / 8 for t in range(0, 63, 3) for s in range(1, 9)}
    gross = {r["date"]: r["gross"] for r in evaluation.QUERIES["bt__accounting"](spark, "").collect()}
    assert len(gross) == 63 and gross[str(day(0))] == pytest.approx(sum((1 if s % 2 == 0 else -1) / 8 * ret[day(0), s] for s in range(1, 9)), abs=1e-5)
    dates = {r["date"] for r in evaluation._ridge(spark, "").select("date").distinct().collect()}
    assert dates == {day(t) for t in range(36, 62)}  # the last date has no label
