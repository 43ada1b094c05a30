"""Edge rules of the operators on small panels."""

import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import ieee
from cadenza.operators import OPERATORS, apply
from cadenza.operators.regression import grouped_ols, rolling_coefficients
from cadenza.plans.catalog import FORMULAS, catalogue
from cadenza.plans.expr import C, O, V, distinct_nodes, parse
from cadenza.plans.stage import Stage
from cadenza.queries import rounded

INF = float("inf")


def panel(spark, rows, columns="e BIGINT, m INT, x DOUBLE"):
    df = spark.createDataFrame(rows, columns)
    for c in ("strict", "listed", "compustat", "linked"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(True))
    return Stage(df)


def values(stage, column):
    return [r[0] for r in stage.df.orderBy("e", "m").select(column).collect()]


def test_division_keeps_infinities_and_loses_zero_over_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in df.select(ieee.div(F.col("a"), F.col("b"))).collect()] == [INF, -INF, None, 2.0, None]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x DOUBLE").select(ieee.ln(F.col("x"))).collect()] == [-INF, None, 0.0]


def test_lags_are_calendar_lags(spark):
    s = panel(spark, [(1, 10, 1.0), (1, 11, 2.0), (1, 14, 3.0)])
    assert values(s, apply("lag", s, F.col("x"), n=1)) == [None, 1.0, None]
    assert values(s, apply("lag", s, F.col("x"), n=3)) == [None, None, 2.0]


def test_compound_return_needs_every_lag(spark):
    s = panel(spark, [(1, k, 0.1) for k in range(5)] + [(1, 6, 0.1), (1, 7, 0.1)])
    got = values(s, apply("compound_return", s, F.col("x"), lags=[1, 2]))
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.21) and got[5:] == [None, None]


def test_constant_window_has_zero_deviation(spark):
    s = panel(spark, [(1, k, 0.1) for k in range(6)])
    assert values(s, apply("rolling_std", s, F.col("x"), window_months=3, min_obs=3))[2:] == [0.0] * 4


def test_deviation_at_a_tie_of_the_rounding(spark):
    # The exact deviation is 85.37005949876999712, just below a tie of queries.rounded; None is a month without a row.
    x = [250, 110, 180, 164, 292, 210, 219, 189, 193, 200, 95, 366, 74, 69, 218, 125, 217, 329, 173, 192, None]
    x += [215, 37, 77, 178, 322, 237, 201, 139, 395, 217, 201, 114, 276, 329, 225]
    s = panel(spark, [(1, k, float(v)) for k, v in enumerate(x) if v is not None] + [(2, 1, 1.0), (2, 2, INF), (3, 1, 1.0), (3, 2, None), (3, 3, 4.0)])
    own = apply("rolling_std", s, F.col("x"), window_months=36, min_obs=2)
    got = values(s, own)
    assert got[34] == statistics.stdev(v for v in x if v is not None)
    assert got[35:] == [None, None, None, None, 4.5**0.5]
    assert values(s, rounded(own))[34] == 85.370059


def test_screens_differ_on_missing_codes(spark):
    s = panel(spark, [(1, 1, 5.0, None), (2, 1, 5.0, 6500.0), (3, 1, 5.0, 2000.0)], "e BIGINT, m INT, x DOUBLE, sic DOUBLE")
    assert values(s, apply("nonfinancial_only", s, F.col("x"), F.col("sic"))) == [None, None, 5.0]
    assert values(s, apply("financial_excluded", s, F.col("x"), F.col("sic"))) == [5.0, None, 5.0]


def test_fastxtile_of_small_sections(spark):
    s = panel(spark, [(1, 1, 1.0), (2, 1, 2.0), (1, 2, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 2, 9.0), (5, 2, 9.0), (6, 2, INF)])
    kept = values(s, apply("monthly_fastxtile_exclude", s, F.col("x"), F.col("x"), n=5, max_excluded=2))
    # Two values are fewer than bins: all are in bin 1.  Of two distinct values, the lower is in bin 1, the higher in 5.
    assert kept == [None, None, None, None, None, 9.0, 9.0, INF]


def test_span_fill_fills_gaps_inside_the_span_only(spark):
    rows = [(1, 1, None, False), (1, 2, 0.5, True), (1, 3, 0.7, False), (1, 4, None, True), (1, 5, 0.9, False)]
    s = panel(spark, rows, "e BIGINT, m INT, x DOUBLE, strict BOOLEAN")
    assert values(s, apply("span_fill", s, F.col("x"), value=0.0)) == [None, 0.5, 0.0, 0.0, None]


def test_infinite_values_leave_a_window_again(spark):
    s = panel(spark, [(1, 1, 1.0), (1, 2, INF), (1, 3, 1.0), (1, 4, 3.0)])
    assert values(s, apply("rolling_mean", s, F.col("x"), window_months=2, min_obs=1)) == [1.0, INF, INF, 2.0]


def test_rank_transform_is_invariant_under_monotone_maps(spark):
    rows = [(k, 1, float(v)) for k, v in enumerate([3, 1, 2, 2, 9])]
    s = panel(spark, rows)
    a = values(s, apply("cs_rank", s, F.col("x")))
    assert a == values(s, apply("cs_rank", s, F.exp("x")))
    assert sum(a) == pytest.approx(0)


def test_grouped_regression_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) * 0.1
    rows = [(int(k % 2), *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    for r in grouped_ols(df, ["g"], "y", ["a", "b", "c"], 5).collect():
        own = np.arange(60) % 2 == r["g"]
        want, rss, *_ = np.linalg.lstsq(np.column_stack([np.ones(30), x[own]]), y[own], rcond=None)
        assert np.allclose([r["b0"], r["b1"], r["b2"], r["b3"]], want) and r["rss"] == pytest.approx(rss[0], rel=1e-6)


def test_collinear_groups_have_no_coefficients(spark):
    df = spark.createDataFrame([(1, float(k), 2.0 * k, float(k * k)) for k in range(9)], "g INT, a DOUBLE, b DOUBLE, y DOUBLE")
    assert grouped_ols(df, ["g"], "y", ["a", "b"], 3).first()["b1"] is None


def test_rolling_regression_uses_trailing_rows(spark):
    rows = [(1, k, float(k), float(k * k), float(2 * k + k * k)) for k in range(12)]
    got = rolling_coefficients(spark.createDataFrame(rows, "e BIGINT, m INT, a DOUBLE, b DOUBLE, y DOUBLE"), "y", ["a", "b"], 6, 6).orderBy("m").collect()
    assert got[4]["b1"] is None and got[8]["b1"] == pytest.approx(2) and got[8]["b2"] == pytest.approx(1)


def test_every_formula_parses_and_names_known_operators():
    trees = catalogue()
    assert len(trees) == len(FORMULAS) == 171
    used = {n.name for t in trees.values() for n in t.nodes().values() if n.kind == "op"}
    assert used <= set(OPERATORS)
    instances, distinct = distinct_nodes(trees)
    assert distinct < instances / 2


def test_equal_trees_are_interned():
    x = V("stock_month", "prc")
    assert O("add", x, C(1)).key == O("add", V("stock_month", "prc"), C(1)).key != O("add", x, C(2)).key
    tree = parse("delta(C.prc, n=3) / C.prc[t-3]", {}, {"C": "stock_month"})
    assert tree.reach == 3 and len(tree.nodes()) == 4


def test_firm_age_counts_rows(spark):
    m0 = 2000 * 12
    s = panel(spark, [(1, m0 + k, 1.0) for k in range(3)])
    assert values(s, apply("firm_age", s, F.col("x"))) == [1.0, 2.0, 3.0]
    assert not math.isnan(values(s, apply("firm_age", s))[0])
    assert datetime.date(1926, 7, 1).year == 1926
