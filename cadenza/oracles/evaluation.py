"""Queries of the backtest and validation layers on the stand-in tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import validation
from cadenza.backtest import models, portfolio, prepare, run
from cadenza.sources.standins import duckdb_with, standins

NAMES = ["mve_c", "prc", "vol"]


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins(spark, sf_dir)("stock_month")
    date = F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1))
    return rows.select(date.alias("date"), F.col("e").alias("stock"), "ret", *NAMES)


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).drop("ret").unpivot(["date", "stock"], NAMES, "factor", "value")


def _r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("date", "stock", "ret")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors with every sixth value taken out."""
    hole = (F.col("stock") + F.year("date") * 12 + F.month("date")) % 6 == 0
    return factors(spark, sf_dir).withColumn("value", F.when(~hole, F.col("value")))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.floor(F.col(c) * F.lit(1e6) + F.lit(0.50123)).cast("double") / F.lit(1e6))
    return df


def _q6(c: str) -> str:
    return f"floor(({c}) * 1e6 + 0.50123e0) / 1e6"


_BASE = f"""WITH {duckdb_with("stock_month")},
raw AS (SELECT make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 + 1 AS INT), 1) AS date, e AS stock, ret, mve_c, prc, vol FROM stock_month),
r AS (SELECT date, stock, ret FROM raw),
f AS (SELECT date, stock, factor, value FROM (SELECT date, stock, 'mve_c' AS factor, mve_c AS value FROM raw UNION ALL SELECT date, stock, 'prc', prc FROM raw UNION ALL SELECT date, stock, 'vol', vol FROM raw)),
d AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS t FROM (SELECT DISTINCT date FROM r)),
al AS (SELECT d2.date, r.stock, r.ret FROM r JOIN d ON r.date = d.date JOIN d d2 ON d2.t = d.t - 1)"""


def _avg_rank(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


_IC = f"""rr AS (SELECT date, stock, {_avg_rank('ret', 'date')} AS rr FROM al WHERE ret IS NOT NULL),
fr AS (SELECT factor, date, stock, {_avg_rank('value', 'factor, date')} AS fr FROM f WHERE value IS NOT NULL),
ic AS (SELECT factor, date, corr(fr, rr) AS ic FROM fr JOIN rr USING (date, stock) GROUP BY factor, date HAVING count(*) >= 30)"""

_LABEL = "lab0 AS (SELECT r.date, stock, t, CASE WHEN count(ret) OVER w = 3 THEN product(1 + ret) OVER w - 1 END AS label FROM r JOIN d ON r.date = d.date WINDOW w AS (PARTITION BY stock ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), lab AS (SELECT date, stock, label FROM lab0 WHERE label IS NOT NULL AND t + 3 <= (SELECT max(t) FROM d))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("date", "stock", F.col("mve_c").alias("score")).where("score IS NOT NULL")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by the sign of a stock's number, on every third date: a book that needs no path."""
    r = _r(spark, sf_dir)
    d = F.broadcast(prepare.dates(r))
    w = F.when(F.col("stock") % 2 == 0, 1.0).otherwise(-1.0)
    rows = r.join(d, "date").where(F.col("t") % 3 == 0).select("date", "stock", w.alias("w"))
    from pyspark.sql import Window as W

    return rows.select("date", "stock", (F.col("w") / F.count("*").over(W.partitionBy("date"))).alias("w"))


def _ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank features; in every window a ridge is fitted on 36 dates and scores the next twelve."""
    r = _r(spark, sf_dir)
    ranked = prepare.rank_transform(prepare.fill_median_by_date(factors(spark, sf_dir)))
    label = prepare.future_spread(r, 1, 1)
    role = prepare.windows(r, 36, 12, 12)
    wide = prepare.training_rows(ranked, label, NAMES)
    wide = wide.join(F.broadcast(role), "date")
    scored = []
    for (k,) in sorted(role.select("window").distinct().collect()):
        own = wide.where(F.col("window") == k)
        model = models.Ridge(1.0).fit(own.where("role = 'train'"), NAMES)
        scored.append(model.predict(own.where("role = 'test'")).select("date", "stock", "score"))
    return reduce(DataFrame.unionByName, scored)


CONFIG = run.Config(train=36, test=12, stock_dates=0.5, stock_factors=0.5, stock_returns=0.5, filters=(("rank_ic", None, 2),), picks=5, exchange=0.4, cost=0.001)


def _run(spark: SparkSession, sf_dir: str) -> run.Result:
    """The whole walk-forward: two of three factors chosen in each window, ranks, ridge, books of five and five."""
    return run.run(factors(spark, sf_dir), _r(spark, sf_dir), NAMES, CONFIG)


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "bt__windows": lambda s, d: prepare.windows(_r(s, d), 24, 12, 12),
    "bt__aligned_returns": lambda s, d: _six(prepare.aligned_returns(_r(s, d)).where("ret IS NOT NULL"), "ret"),
    "bt__available_stocks": lambda s, d: prepare.available_stocks(factors(s, d), _r(s, d), 0.6, 0.9, 0.85),
    "bt__rank_correlations": lambda s, d: _six(prepare.rank_correlations(factors(s, d), prepare.aligned_returns(_r(s, d)), 30), "ic"),
    "bt__factor_metrics": lambda s, d: _six(prepare.factor_metrics(factors(s, d), prepare.aligned_returns(_r(s, d)), 30), "rank_ic", "rank_ir"),
    "bt__future_return": lambda s, d: _six(prepare.future_return(_r(s, d), 3, 1), "label"),
    "bt__future_spread": lambda s, d: _six(prepare.future_spread(_r(s, d), 3, 1), "label"),
    "bt__current_return": lambda s, d: _six(prepare.current_return(_r(s, d), 2), "label"),
    "bt__fill_from_training": lambda s, d: _six(prepare.fill_from_training(_gaps(s, d).where(F.year("date") >= 1995), _gaps(s, d).where((F.year("date") < 1995) & (F.col("stock") % 3 != 0))).where("value IS NOT NULL"), "value"),
    "bt__fill_median_by_date": lambda s, d: _six(prepare.fill_median_by_date(factors(s, d)), "value"),
    "bt__fill_median_by_stock": lambda s, d: _six(prepare.fill_median_by_stock(factors(s, d)), "value"),
    "bt__scale": lambda s, d: _six(prepare.apply_scale(factors(s, d), prepare.fit_scale(factors(s, d))).where("value IS NOT NULL"), "value"),
    "bt__rank_transform": lambda s, d: _six(prepare.rank_transform(factors(s, d)).where("value IS NOT NULL"), "value"),
    "bt__month_end_returns": lambda s, d: _six(prepare.month_end_returns(standins(s, d)("stock_day").select(F.col("d").alias("date"), F.col("e").alias("stock"), "ret")).where("ret IS NOT NULL"), "ret"),
    "bt__accounting": lambda s, d: _six(portfolio.accounting(_book(s, d), _r(s, d)), "gross", "turnover"),
    "bt__performance": lambda s, d: _six(portfolio.performance(portfolio.accounting(_book(s, d), _r(s, d)), 0.001), "total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "mean_turnover"),
    "bt__yearly": lambda s, d: _six(portfolio.performance(portfolio.accounting(_book(s, d), _r(s, d)), 0.001, by_year=True), "total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "mean_turnover"),
    "bt__legs": lambda s, d: _six(portfolio.legs(_book(s, d)), "w"),
    "bt__ridge": lambda s, d: _six(_ridge(s, d), "score"),
    "bt__portfolio": lambda s, d: _six(portfolio.form_portfolio(_scores(s, d), 5, 0.4), "w"),
    "bt__run_scores": lambda s, d: _six(_run(s, d).scores, "score"),
    "bt__run_book": lambda s, d: _six(_run(s, d).book, "gross", "turnover"),
    "val__diff_panels": lambda s, d: _six(validation.diff_panels(_panel(s, d, "prc"), _panel(s, d, "shrout")), "max_abs_diff"),
    "val__vintages": lambda s, d: _six(validation.compare_vintages(_vintage(s, d, 0), _vintage(s, d, 1), ["e", "m"]), "share_changed"),
    "val__classify": lambda s, d: _six(validation.classify_factors(_long(s, d, 0), _long(s, d, 1), 24000), "share"),
}


def _panel(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return standins(spark, sf_dir)("stock_month").select("e", "m", F.when(F.col("m") % 7 != (0 if column == "prc" else 1), F.col(column)).alias("value"))


def _vintage(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = standins(spark, sf_dir)("stock_month").where(F.col("m") % 11 != k)
    return rows.select("e", "m", "vol", F.when(F.lit(k == 1) & (F.col("e") % 9 == 0), F.col("prc") + 1).otherwise(F.col("prc")).alias("prc"))


def _long(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = standins(spark, sf_dir)("stock_month").select("e", "m", "vol", F.when(F.lit(k == 1) & (F.col("e") % 9 == 0), F.col("prc") + 1).otherwise(F.col("prc")).alias("prc"))
    return rows.unpivot(["e", "m"], ["vol", "prc"], "factor", "value")


_BOOK = """wt AS (SELECT r.date, t, stock, (CASE WHEN stock % 2 = 0 THEN 1.0 ELSE -1.0 END) / count(*) OVER (PARTITION BY r.date) AS w FROM r JOIN d ON r.date = d.date WHERE t % 3 = 0),
books AS (SELECT DISTINCT t AS book FROM wt),
grid AS (SELECT d.date, d.t, max(book) AS book FROM d JOIN books ON book <= d.t GROUP BY d.date, d.t),
own AS (SELECT g.date, g.t, g.book, wt.stock, wt.w, product(1 + coalesce(r.ret, 0)) OVER (PARTITION BY g.book, wt.stock ORDER BY g.t) AS gr FROM grid g JOIN wt ON wt.t = g.book LEFT JOIN r ON r.date = g.date AND r.stock = wt.stock),
val AS (SELECT date, t, book, 1 + sum(w * (gr - 1)) AS v FROM own GROUP BY date, t, book),
gross AS (SELECT date, t, v / coalesce(lag(v) OVER (PARTITION BY book ORDER BY t), 1) - 1 AS gross FROM val),
was AS (SELECT o.t + 1 AS book, o.stock, o.w * o.gr / v.v AS w0 FROM own o JOIN val v ON o.t = v.t AND o.book = v.book WHERE o.t = (SELECT max(t) FROM grid x WHERE x.book = o.book)),
turn AS (SELECT coalesce(a.t, b.book) AS t, sum(abs(coalesce(a.w, 0) - coalesce(b.w0, 0))) / 2 AS turnover FROM wt a FULL JOIN was b ON a.t = b.book AND a.stock = b.stock GROUP BY 1),
acc AS (SELECT g.date, gross, coalesce(turnover, 0) AS turnover FROM gross g LEFT JOIN turn USING (t))"""


def _performance(year: str) -> str:
    w = "PARTITION BY year ORDER BY date"
    return f"""net AS (SELECT date, {year} AS year, gross - 0.001 * turnover AS net, turnover FROM acc),
cum AS (SELECT *, product(1 + net) OVER ({w}) AS v FROM net),
dd AS (SELECT *, v / greatest(max(v) OVER ({w}), 1) - 1 AS dd FROM cum)
SELECT year, count(*) AS periods, {_q6('product(1 + net) - 1')} AS total_return, {_q6('power(product(1 + net), 12.0 / count(*)) - 1')} AS annual_return, {_q6('coalesce(stddev_samp(net), 0) * sqrt(12)')} AS volatility,
  {_q6('CASE WHEN coalesce(stddev_samp(net), 0) > 0 THEN avg(net) / stddev_samp(net) * sqrt(12) ELSE 0 END')} AS sharpe, {_q6('min(dd)')} AS max_drawdown, {_q6('avg(turnover)')} AS mean_turnover FROM dd GROUP BY year"""


_TWO = f"WITH {duckdb_with('stock_month')}"
_V = "a AS (SELECT e, m, vol, prc FROM stock_month WHERE m % 11 <> 0), b AS (SELECT e, m, vol, CASE WHEN e % 9 = 0 THEN prc + 1 ELSE prc END AS prc FROM stock_month WHERE m % 11 <> 1), j AS (SELECT a.e IS NOT NULL AS ina, b.e IS NOT NULL AS inb, a.vol AS v1, b.vol AS v2, a.prc AS p1, b.prc AS p2 FROM a FULL JOIN b ON a.e = b.e AND a.m = b.m)"


def _changed(a: str, b: str) -> str:
    return f"count(*) FILTER (WHERE ina AND inb AND (({a} IS NULL) <> ({b} IS NULL) OR coalesce(abs({a} - {b}) > 1e-6 AND abs({a} - {b}) > 1e-6 * abs({a}), false)))"


SQL: dict[str, str] = {
    "bt__windows": f"{_BASE} SELECT CAST(s.t / 12 AS INT) AS \"window\", x.date, CASE WHEN x.t < s.t + 24 THEN 'train' ELSE 'test' END AS role FROM d s JOIN d x ON x.t BETWEEN s.t AND s.t + 35 WHERE s.t % 12 = 0 AND s.t + 24 < (SELECT count(*) FROM d)",
    "bt__aligned_returns": f"{_BASE} SELECT date, stock, {_q6('ret')} AS ret FROM al WHERE ret IS NOT NULL",
    "bt__available_stocks": f"{_BASE} SELECT stock FROM (SELECT stock, factor FROM f WHERE value IS NOT NULL GROUP BY stock, factor HAVING count(DISTINCT date) >= 0.9 * (SELECT count(*) FROM d)) GROUP BY stock HAVING count(*) >= 0.6 * 3 INTERSECT SELECT stock FROM r WHERE ret IS NOT NULL GROUP BY stock HAVING count(*) >= 0.85 * (SELECT count(*) FROM d)",
    "bt__rank_correlations": f"{_BASE}, {_IC} SELECT factor, date, {_q6('ic')} AS ic FROM ic",
    "bt__factor_metrics": f"{_BASE}, {_IC} SELECT factor, {_q6('abs(avg(ic))')} AS rank_ic, {_q6('abs(avg(ic) / stddev_samp(ic))')} AS rank_ir FROM ic GROUP BY factor",
    "bt__future_return": f"{_BASE}, {_LABEL} SELECT date, stock, {_q6('label')} AS label FROM lab",
    "bt__future_spread": f"{_BASE}, {_LABEL}, mean AS (SELECT t, avg(ret) AS ret FROM r JOIN d ON r.date = d.date GROUP BY t), market AS (SELECT d.date, product(1 + mean.ret) - 1 AS market FROM d JOIN mean ON mean.t BETWEEN d.t + 1 AND d.t + 3 GROUP BY d.date HAVING count(mean.ret) = 3) SELECT lab.date, stock, {_q6('label - market')} AS label FROM lab JOIN market ON lab.date = market.date",
    "bt__current_return": f"{_BASE}, x AS (SELECT d2.date, r.stock, r.ret FROM r JOIN d ON r.date = d.date JOIN d d2 ON d2.t = d.t - 2) SELECT date, stock, {_q6('ret')} AS label FROM x WHERE ret IS NOT NULL",
    "bt__fill_from_training": f"{_BASE}, s AS (SELECT date, stock, factor, CASE WHEN (stock + year(date) * 12 + month(date)) % 6 <> 0 THEN value END AS value FROM f), tr AS (SELECT * FROM s WHERE year(date) < 1995 AND stock % 3 <> 0), ev AS (SELECT factor, median(value) AS every FROM tr GROUP BY factor), ow AS (SELECT factor, stock, median(value) AS own FROM tr GROUP BY factor, stock), a AS (SELECT s.date, s.stock, s.factor, every, coalesce(s.value, own, CASE WHEN ow.stock IS NOT NULL THEN every END) AS v FROM s LEFT JOIN ev ON s.factor = ev.factor LEFT JOIN ow ON s.factor = ow.factor AND s.stock = ow.stock WHERE year(s.date) >= 1995), b AS (SELECT *, coalesce(v, median(v) OVER (PARTITION BY factor, date), every) AS w FROM a) SELECT date, stock, factor, {_q6('w')} AS value FROM b WHERE w IS NOT NULL",
    "bt__fill_median_by_date": f"{_BASE}, x AS (SELECT date, stock, factor, coalesce(value, median(value) OVER (PARTITION BY factor, date)) AS v FROM f) SELECT date, stock, factor, {_q6('v')} AS value FROM x",
    "bt__fill_median_by_stock": f"{_BASE}, x AS (SELECT date, stock, factor, coalesce(value, median(value) OVER (PARTITION BY factor, stock)) AS v FROM f) SELECT date, stock, factor, {_q6('v')} AS value FROM x",
    "bt__scale": f"{_BASE}, sc AS (SELECT factor, avg(value) AS mu, stddev_samp(value) AS sd FROM f GROUP BY factor) SELECT date, stock, factor, {_q6('(value - mu) / sd')} AS value FROM f JOIN sc USING (factor) WHERE value IS NOT NULL",
    "bt__rank_transform": f"{_BASE}, x AS (SELECT date, stock, factor, 2 * {_avg_rank('value', 'factor, date')} / (count(*) OVER (PARTITION BY factor, date) + 1) - 1 AS v FROM f WHERE value IS NOT NULL) SELECT date, stock, factor, {_q6('v')} AS value FROM x",
    "bt__month_end_returns": f"WITH {duckdb_with('stock_day')}, x AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, e AS stock, product(1 + ret) - 1 AS ret FROM stock_day GROUP BY 1, 2 HAVING count(ret) = count(*)) SELECT month, stock, {_q6('ret')} AS ret FROM x",
    "bt__accounting": f"{_BASE}, {_BOOK} SELECT date, {_q6('gross')} AS gross, {_q6('turnover')} AS turnover FROM acc",
    "bt__performance": f"{_BASE}, {_BOOK}, " + _performance("'all'"),
    "bt__yearly": f"{_BASE}, {_BOOK}, " + _performance("CAST(year(date) AS INT)"),
    "bt__legs": f"{_BASE}, {_BOOK}, x AS (SELECT 'long' AS leg, date, stock, w / sum(w) OVER (PARTITION BY date) AS w FROM wt WHERE w > 0 UNION ALL SELECT 'short', date, stock, w / abs(sum(w) OVER (PARTITION BY date)) FROM wt WHERE w < 0 UNION ALL SELECT 'long_short', date, stock, w / sum(abs(w)) OVER (PARTITION BY date) FROM wt) SELECT leg, date, stock, {_q6('w')} AS w FROM x",
    "val__diff_panels": f"{_TWO}, a AS (SELECT e, m, prc AS a FROM stock_month WHERE m % 7 <> 0 AND prc IS NOT NULL), b AS (SELECT e, m, shrout AS b FROM stock_month WHERE m % 7 <> 1), j AS (SELECT a, b FROM a FULL JOIN b ON a.e = b.e AND a.m = b.m) SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only, count(*) FILTER (WHERE a <> b) AS differing, {_q6('max(abs(a - b))')} AS max_abs_diff, false AS equal FROM j",
    "val__vintages": f"{_TWO}, {_V}, s AS (SELECT count(*) FILTER (WHERE ina AND inb) AS common, count(*) FILTER (WHERE NOT inb) AS gone, count(*) FILTER (WHERE NOT ina) AS added, {_changed('v1', 'v2')} AS cv, {_changed('p1', 'p2')} AS cp FROM j) SELECT 'vol' AS \"column\", common, gone, added, cv AS changed, {_q6('cv / common')} AS share_changed FROM s UNION ALL SELECT 'prc', common, gone, added, cp, {_q6('cp / common')} FROM s",
    "val__classify": f"{_TWO}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE e % 9 = 0) AS c FROM stock_month WHERE m <= 24000), x AS (SELECT 'vol' AS factor, n AS cells, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS added FROM s UNION ALL SELECT 'prc', n, c, CAST(0 AS BIGINT) FROM s) SELECT factor, cells, changed, added, {_q6('changed / cells')} AS share, CASE WHEN changed = 0 THEN 'identical' WHEN changed / cells > 0.2 THEN 'suspect' WHEN changed / cells <= 0.01 THEN 'restated_minor' ELSE 'restated' END AS verdict FROM x",
}


def _dated(query: Query) -> Query:
    """Dates as text: engines hand them over as different types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))

    return run


for _name in QUERIES:
    QUERIES[_name] = _dated(QUERIES[_name])
    if _name in SQL and _name.startswith("bt__") and _name not in ("bt__available_stocks", "bt__factor_metrics", "bt__performance", "bt__yearly"):
        _column = "month" if _name == "bt__month_end_returns" else "date"
        SQL[_name] = f'SELECT * REPLACE (CAST("{_column}" AS VARCHAR) AS "{_column}") FROM ({SQL[_name]}) q'
