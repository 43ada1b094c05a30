"""Queries of the operators that join tables or start from daily rows, with SQL where SQL can say the same.

Regressions on three and more variables, forecasts and event windows are checked against numpy in the tests instead.
"""

from __future__ import annotations

from cadenza.oracles.panel import ROUNDED, frame, lag, number, ratio, so_far
from cadenza.plans.catalog import DATASETS, shared
from cadenza.plans.expr import Expr, parse
from cadenza.sources.standins import duckdb_with

#: Query name -> formula, and SQL or None.
CASES: dict[str, tuple[str, str | None]] = {}


def table_case(name: str, formula: str, tables: list[str], body: str) -> None:
    """``body`` is a CTE list that ends in z(e, m, v)."""
    CASES[name] = (formula, f"WITH {duckdb_with(*tables)},\n{body}\nSELECT e, m, {ROUNDED} AS value FROM z WHERE v IS NOT NULL AND NOT isnan(v) AND (e, m) IN (SELECT e, m FROM spine)")


def rows_only(name: str, formula: str) -> None:
    CASES[name] = (formula, None)


MS = "ms_signal(A.at, A.ceq, A.ni, A.oancf, A.fopt, A.wcapch, A.ib, A.dp, A.xrd, A.capx, A.xad, A.revt, C.mve_permco, C.sicCRSP, Q.niq, Q.atq, Q.saleq, Q.oancfy, Q.capxy, Q.xrdq, Q.fqtr)"
_SPINE = "spine AS (SELECT e, CAST(unnest(range(lo, hi + 1)) AS INT) AS m FROM (SELECT e, min(m) AS lo, max(m) AS hi FROM stock_month GROUP BY e))"


def _month(d: str) -> str:
    return f"CAST(year({d}) * 12 + month({d}) - 1 AS INT)"


_DAYS = f"days AS (SELECT *, {_month('d')} AS m FROM stock_day)"
_TICKERS = "tickers AS (SELECT e, m, ticker FROM universe WHERE ticker IS NOT NULL)"


def _held(months: int, reach: bool = True) -> str:
    """z from stamped(e, m, v): the newest stamp of the last months wins."""
    return f"z AS (SELECT e, m, v FROM (SELECT s.e, CAST(s.m + k AS INT) AS m, v, row_number() OVER (PARTITION BY s.e, s.m + k ORDER BY s.m DESC) AS rn FROM stamped s, range(0, {months}) t(k)) WHERE rn = 1)"


def _fill() -> None:
    t = ["stock_month", "stock_day"]
    stat = {
        "mean": ("avg(x)", "n"),
        "max": ("max(x)", "n"),
        "sum": ("coalesce(sum(x), 0)", "n"),
        "std": ("CASE WHEN n > 1 THEN stddev_samp(x) END", "n"),
        "last": ("arg_max(struct_pack(x := x), d).x", "n"),
        "skew": ("CASE WHEN min(x) < max(x) THEN (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (avg(x * x) - avg(x) * avg(x)) ** 1.5 END", "rows"),
    }
    for name, (expr, mode) in stat.items():
        n = "count(*)" if mode == "rows" else "count(x)"
        expr = expr.replace("n > 1", "count(x) > 1")
        mode_param = ", min_obs_mode='rows'" if mode == "rows" else ""
        table_case(f"daily__{name}", f"daily_monthly_stat(stat='{name}', min_obs=5{mode_param})", t, f"{_SPINE}, {_DAYS}, z AS (SELECT e, m, CASE WHEN {n} >= 5 THEN {expr} END AS v FROM (SELECT e, m, d, ret AS x FROM days) GROUP BY e, m)")
    derived = {"amihud": ratio("abs(ret)", "abs(prc) * vol"), "zerovol": "CASE WHEN vol = 0 THEN 1 ELSE 0 END", "turnover": ratio("vol", "shrout"), "one": "1.0", "absprc": "abs(prc)"}
    for name, expr in derived.items():
        table_case(f"daily__{name}", f"daily_monthly_stat(stat='mean', derive='{name}', min_obs=1)", t, f"{_SPINE}, {_DAYS}, z AS (SELECT e, m, list_avg(list(x) FILTER (WHERE x IS NOT NULL AND NOT isnan(x))) AS v FROM (SELECT e, m, CAST({expr} AS DOUBLE) AS x FROM days) GROUP BY e, m)")
    table_case("daily__monthly_mean", "monthly_mean()", t, f"{_SPINE}, {_DAYS}, z AS (SELECT e, m, avg(ret) AS v FROM days GROUP BY e, m)")
    table_case("daily__monthly_max", "monthly_max()", t, f"{_SPINE}, {_DAYS}, z AS (SELECT e, m, max(ret) AS v FROM days GROUP BY e, m)")
    table_case("daily__monthly_skew", "monthly_skew(min_obs=6)", t, f"{_SPINE}, {_DAYS}, z AS (SELECT e, m, CASE WHEN count(ret) >= 6 AND min(ret) < max(ret) THEN skewness(ret) END AS v FROM days GROUP BY e, m)")
    high = f"{_SPINE}, {_DAYS}, top AS (SELECT e, m, max(abs(prc)) AS hi, arg_max(abs(prc), d) AS last FROM days WHERE prc IS NOT NULL GROUP BY e, m), grid AS (SELECT s.e, s.m, hi, last FROM spine s LEFT JOIN top USING (e, m)), z AS (SELECT e, m, last / {frame('max(hi)', 12, 1)} AS v FROM grid)"
    table_case("daily__high52_signal", "high52_signal()", t, high)
    table_case("daily__high_52", "high_52()", t, high)
    zero = f"{_SPINE}, {_DAYS}, mon AS (SELECT e, m, sum(CASE WHEN vol = 0 THEN 1.0 ELSE 0 END) AS zd, sum(vol / shrout) AS tn, count(*) AS n FROM days GROUP BY e, m), grid AS (SELECT s.e, s.m, zd, tn, n FROM spine s LEFT JOIN mon USING (e, m)), w AS (SELECT *, CASE WHEN {frame('count(n)', 5)} = 6 THEN ({frame('sum(zd)', 5)} + 1 / {frame('sum(tn)', 5)} / 11000) * 126 / {frame('sum(n)', 5)} END AS x FROM grid), z AS (SELECT e, m, CASE WHEN n IS NOT NULL THEN {lag('x', 1)} END AS v FROM w)"
    table_case("daily__zerotrade_signal", "zerotrade_signal(window=6, deflator=11000.0)", t, zero)
    market = [*t, "factors_day"]
    rmse = "ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"
    table_case("daily__rolling_market_rmse", "rolling_market_rmse(window=60, min_obs=30)", market, f"{_SPINE}, {_DAYS}, v0 AS (SELECT e, m, d, ret - rf AS y, mktrf AS x FROM days JOIN factors_day USING (d) WHERE ret IS NOT NULL), r AS (SELECT e, m, d, CASE WHEN count(*) OVER w >= 30 AND regr_sxx(y, x) OVER w > 0 THEN sqrt(greatest(0, regr_syy(y, x) OVER w - regr_sxy(y, x) OVER w ** 2 / regr_sxx(y, x) OVER w) / (count(*) OVER w - 2)) END AS s FROM v0 WINDOW w AS (PARTITION BY e ORDER BY d {rmse})), z AS (SELECT e, m, arg_max(struct_pack(s := s), d).s AS v FROM r GROUP BY e, m)")
    monthly = ["stock_month", "market_month", "factors_month"]
    table_case("regress__monthly_rolling_beta", "monthly_rolling_beta(x_dataset='market_month', x_column='ewretd', window=36, min_obs=20, y_excess=True, x_excess=True)", monthly, f"{_SPINE}, rows AS (SELECT e, m, max(ret) AS ret FROM stock_month GROUP BY e, m), valid AS (SELECT e, m, ret - rf AS y, ewretd - rf AS x FROM rows JOIN market_month USING (m) JOIN factors_month USING (m) WHERE ret IS NOT NULL), b AS (SELECT e, m, CASE WHEN count(*) OVER w >= 20 THEN regr_slope(y, x) OVER w END AS b FROM valid WINDOW w AS (PARTITION BY e ORDER BY m ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)), j AS (SELECT rows.e, rows.m, b FROM rows LEFT JOIN b ON rows.e = b.e AND rows.m = b.m), z AS (SELECT e, m, {so_far('last_value(b IGNORE NULLS)')} AS v FROM j)")
    tail = "pool AS (SELECT m, ret FROM days WHERE ret IS NOT NULL), edge AS (SELECT m, list_sort(list(ret))[CAST(floor(0.05 * (count(*) - 1)) AS INT) + 1] AS p5 FROM pool GROUP BY m), tail AS (SELECT m, avg(CASE WHEN ret / p5 > 0 THEN ln(ret / p5) END) AS x FROM pool JOIN edge USING (m) WHERE ret <= p5 GROUP BY m)"
    table_case("regress__betatailrisk_signal", "betatailrisk_signal(window=48, min_obs=24)", t, f"{_SPINE}, {_DAYS}, {tail}, rows AS (SELECT e, m, max(ret) AS ret, max(shrcd) AS shrcd FROM stock_month GROUP BY e, m), valid AS (SELECT e, m, ret AS y, x FROM rows JOIN tail USING (m) WHERE ret IS NOT NULL AND x IS NOT NULL), b AS (SELECT e, m, CASE WHEN count(*) OVER w >= 24 THEN regr_slope(y, x) OVER w END AS b FROM valid WINDOW w AS (PARTITION BY e ORDER BY m ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)), j AS (SELECT rows.e, rows.m, shrcd, {'b'} FROM rows LEFT JOIN b ON rows.e = b.e AND rows.m = b.m), c AS (SELECT e, m, shrcd, {so_far('last_value(b IGNORE NULLS)')} AS b FROM j), z AS (SELECT e, m, CASE WHEN shrcd <= 11 THEN b END AS v FROM c)")
    # Long-form joins.
    u = ["stock_month", "universe"]
    table_case("join__cash_rdq_signal", "cash_rdq_signal()", [*u, "statement_quarter"], f"{_SPINE}, one AS (SELECT * FROM (SELECT firm, rdq, cheq, atq, datadateq, row_number() OVER (PARTITION BY firm, rdq ORDER BY fyearq DESC, fqtr DESC, datadateq DESC) AS rn FROM statement_quarter WHERE rdq IS NOT NULL) WHERE rn = 1), spread AS (SELECT firm, CAST({_month('rdq')} + k AS INT) AS m, rdq, datadateq, cheq, atq FROM one, range(0, 3) t(k)), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, m ORDER BY rdq DESC, datadateq DESC) AS rn2 FROM spread) WHERE rn2 = 1), z AS (SELECT e, m, CASE WHEN atq > 0 THEN cheq / atq END AS v FROM universe JOIN newest USING (firm, m))")
    table_case("join__feps_signal", "feps_signal()", [*u, "estimates"], f"{_SPINE}, {_TICKERS}, z AS (SELECT e, m, max(meanest) AS v FROM tickers JOIN estimates USING (ticker, m) WHERE fpi = '1' GROUP BY e, m)")
    rec = f"lastrec AS (SELECT ticker, {_month('day')} AS m, analyst, arg_max(ireccd, day) AS r FROM recommendations WHERE ireccd IS NOT NULL GROUP BY 1, 2, 3), rec AS (SELECT ticker, m, avg(r) AS level FROM lastrec GROUP BY ticker, m)"
    before = "rec2 AS (SELECT *, lag(level) OVER (PARTITION BY ticker ORDER BY m) AS l FROM rec)"
    rt = [*u, "recommendations"]
    table_case("join__binary_recommendation_level", "binary_recommendation_level(low_threshold=2.5, high_threshold=3.5)", rt, f"{_SPINE}, {_TICKERS}, {rec}, z AS (SELECT e, m, max(CASE WHEN level > 3.5 THEN 1 WHEN level <= 2.5 THEN 0 END) AS v FROM tickers JOIN rec USING (ticker, m) GROUP BY e, m)")
    for way, sign in (("up", "<"), ("down", ">")):
        table_case(f"join__recommendation_change_{way}", f"recommendation_change_indicator(direction='{way}')", rt, f"{_SPINE}, {_TICKERS}, {rec}, {before}, z AS (SELECT e, m, max(CASE WHEN coalesce(level {sign} l, false) THEN 1 ELSE 0 END) AS v FROM tickers JOIN rec2 USING (ticker, m) GROUP BY e, m)")
    table_case("join__change_in_recommendation_signal", "change_in_recommendation_signal()", rt, f"{_SPINE}, {_TICKERS}, {rec}, {before}, z AS (SELECT e, m, max((6 - level) - (6 - l)) AS v FROM tickers JOIN rec2 USING (ticker, m) GROUP BY e, m)")
    e3 = [*u, "estimates", "actuals"]
    table_case("join__earnings_forecast_disparity", "earnings_forecast_disparity_signal()", e3, f"{_SPINE}, {_TICKERS}, a AS (SELECT e, m, max(meanest) AS s FROM tickers JOIN estimates USING (ticker, m) WHERE fpi = '1' AND fpedats > statpers + 30 GROUP BY e, m), b AS (SELECT e, m, max(meanest) AS l FROM tickers JOIN estimates USING (ticker, m) WHERE fpi = '0' GROUP BY e, m), c AS (SELECT e, m, max(fy0a) AS f FROM tickers JOIN actuals USING (ticker, m) GROUP BY e, m), z AS (SELECT e, m, l - CASE WHEN f <> 0 THEN 100 * (s - f) / abs(f) END AS v FROM a JOIN b USING (e, m) JOIN c USING (e, m))")
    table_case("join__excluded_expenses_signal", "excluded_expenses_signal()", [*u, "statement_quarter", "actuals"], f"{_SPINE}, j AS (SELECT u.e, u.m, int0a - epspiq AS x FROM universe u JOIN statement_quarter q ON u.firm = q.firm AND u.m = q.m LEFT JOIN actuals a ON u.ticker = a.ticker AND u.m = a.m), k AS (SELECT e, m, x, quantile_cont(x, 0.01) OVER (PARTITION BY m) AS lo, quantile_cont(x, 0.99) OVER (PARTITION BY m) AS hi FROM j WHERE x IS NOT NULL), z AS (SELECT e, m, max(least(greatest(x, lo), hi)) AS v FROM k GROUP BY e, m)")
    table_case("join__earnings_increase_streak", "earnings_increase_streak()", [*u, "statement_quarter"], f"{_SPINE}, j AS (SELECT e, m, max(ibq) AS ibq FROM universe JOIN statement_quarter USING (firm, m) GROUP BY e, m), c AS (SELECT e, m, ibq - {lag('ibq', 12)} AS c FROM j), l AS (SELECT e, m, [c" + "".join(f", {lag('c', 3 * k)}" for k in range(1, 9)) + "] AS c FROM c), z AS (SELECT e, m, coalesce(list_max(list_filter(range(1, 9), lambda k: coalesce(c[k + 1] <= 0, false) AND len(list_filter(c[1:k], lambda x: x <= 0)) = 0)), 0) AS v FROM l)")
    brand = "ranked AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY fyear, datadate) AS rn FROM statement_year), stock AS (SELECT a.firm, a.rn, sum(coalesce(b.xad, 0) / CASE WHEN b.rn = 1 THEN 0.6 ELSE 1 END * power(0.5, a.rn - b.rn)) AS bc FROM ranked a JOIN ranked b ON a.firm = b.firm AND b.rn <= a.rn GROUP BY a.firm, a.rn)"
    table_case("join__brand_invest_signal", "brand_invest_signal()", ["stock_month", "statement_year"], f"{_SPINE}, {brand}, cap AS (SELECT r.*, CASE WHEN xad IS NOT NULL THEN {ratio('bc', 'r.\"at\"')} END AS cap FROM ranked r JOIN stock s ON r.firm = s.firm AND r.rn = s.rn), inv AS (SELECT *, lag(cap) OVER (PARTITION BY firm ORDER BY rn) AS l FROM cap), stamped AS (SELECT e, m, {ratio('xad0', 'l')} AS v FROM inv WHERE NOT coalesce({number('sic')} BETWEEN 4900 AND 4999, false) AND NOT coalesce({number('sic')} BETWEEN 6000 AND 6999, false) AND month(datadate) = 12), {_held(12)}")
    recursion = ["r0 AS (SELECT firm, e, m, datadate, ceq, prcc_f * csho AS me, ib / nullif(lag(ceq) OVER w, 0) AS roe, coalesce(sale / nullif(lag(sale) OVER w, 0) - 1, 0) AS g FROM statement_year WINDOW w AS (PARTITION BY firm ORDER BY fyear, datadate))", "b0 AS (SELECT *, ceq AS bv, CAST(0 AS DOUBLE) AS wsum, CAST(0 AS DOUBLE) AS psum FROM r0)"]
    for k in range(1, 11):
        recursion.append(f"n{k} AS (SELECT * REPLACE (0.57 * roe + 0.12 * 0.43 AS roe, 0.24 * g + 0.06 * 0.76 AS g) FROM b{k - 1})")
        recursion.append(f"b{k} AS (SELECT * REPLACE (bv * (1 + g) AS bv, wsum + {k} * (bv - bv * (1 + g) + bv * roe) / power(1.12, {k}) AS wsum, psum + (bv - bv * (1 + g) + bv * roe) / power(1.12, {k}) AS psum) FROM n{k})")
    table_case("join__equity_duration_signal", "equity_duration_signal()", ["stock_month", "statement_year"], f"{_SPINE}, {', '.join(recursion)}, stamped AS (SELECT e, m, ({ratio('wsum', 'me')}) + (10 + 1.12 / 0.12) * (1 - ({ratio('psum', 'me')})) AS v FROM b10), {_held(12)}")
    div = "paid0 AS (SELECT e, m, sum(divamt) AS d FROM distributions WHERE cd1 = 1 AND cd2 IN (2, 3) GROUP BY e, m), flags AS (SELECT e, m, bool_or(shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3)) AS strict FROM stock_month GROUP BY e, m), grid AS (SELECT s.e, s.m, coalesce(strict, false) AS strict, CASE WHEN strict THEN coalesce(d, 0) END AS d FROM spine s LEFT JOIN flags USING (e, m) LEFT JOIN paid0 USING (e, m))"
    dt = ["stock_month", "distributions"]
    table_case("event__dividend_initiation_flag", "dividend_initiation_flag()", dt, f"{_SPINE}, {div}, a AS (SELECT *, {frame('sum(d)', 23)} AS s FROM grid), b AS (SELECT *, CASE WHEN d > 0 AND {lag('s', 1)} < 1e-10 THEN 1 ELSE 0 END AS f FROM a), z AS (SELECT e, m, {frame('max(f)', 5)} AS v FROM b)")
    omit, tests = "", []
    last = "o"
    for k, (w, h, p) in enumerate(((3, 18, 3), (6, 18, 6), (12, 24, 12))):
        omit += f", c{k} AS (SELECT *, {frame('sum(paid)', w - 1)} AS s{k} FROM {last}), t{k} AS (SELECT *, CASE WHEN inside THEN CASE WHEN coalesce(s{k} = 1, false) THEN 1.0 ELSE 0 END END AS once{k} FROM c{k}), u{k} AS (SELECT *, CASE WHEN inside THEN CASE WHEN {frame(f'avg(once{k})', h - 1)} = 1 THEN 1.0 ELSE 0 END END AS pay{k} FROM t{k}), v{k} AS (SELECT *, {lag(f's{k}', 1)} AS sl{k}, {lag(f'pay{k}', p)} AS pl{k} FROM u{k})"
        tests.append(f"coalesce(s{k} = 0 AND sl{k} > 0 AND pl{k} = 1, false)")
        last = f"v{k}"
    inside = "m BETWEEN min(CASE WHEN strict THEN m END) OVER (PARTITION BY e) AND max(CASE WHEN strict THEN m END) OVER (PARTITION BY e)"
    table_case("event__dividend_omission_flag", "dividend_omission_flag()", dt, f"{_SPINE}, {div}, o AS (SELECT *, CASE WHEN strict THEN CASE WHEN d > 0 THEN 1.0 ELSE 0 END END AS paid, {inside} AS inside FROM grid){omit}, w AS (SELECT *, CASE WHEN inside THEN CASE WHEN {' OR '.join(tests)} THEN 1.0 ELSE 0 END END AS now FROM {last}), z AS (SELECT e, m, CASE WHEN coalesce({frame('sum(now)', 1)} = 1, false) THEN 1 ELSE 0 END AS v FROM w)")
    ut = [*u, "estimates"]
    along = "OVER (PARTITION BY ticker ORDER BY m)"
    table_case("join__sum_scaled_revisions", "sum_scaled_revisions()", ut, f"{_SPINE}, {_TICKERS}, e0 AS (SELECT ticker, m, meanest, fpedats, statpers, lag(meanest) {along} AS l, lag(fpedats) {along} AS pe FROM estimates WHERE fpi = '1'), e1 AS (SELECT ticker, m, CASE WHEN NOT coalesce(fpedats > statpers + 30, false) AND coalesce(fpedats = pe, false) AND l IS NOT NULL THEN l ELSE meanest END AS x FROM e0), est AS (SELECT e, m, max(x) AS x FROM tickers JOIN e1 USING (ticker, m) GROUP BY e, m), pr AS (SELECT e, m, max(prc) AS prc FROM universe GROUP BY e, m), g AS (SELECT s.e, s.m, x, prc FROM spine s LEFT JOIN est USING (e, m) LEFT JOIN pr USING (e, m)), r AS (SELECT e, m, (x - {lag('x', 1)}) / nullif(abs({lag('prc', 1)}), 0) AS r FROM g), z AS (SELECT e, m, CASE WHEN {frame('count(r)', 6)} = 7 THEN {frame('sum(r)', 6)} END AS v FROM r)")
    sm = [*u, "estimates", "statement_month"]
    diff = " - ".join(["(act - act_l)", "(che - che_l)", "((lct - lct_l) - (dlc - dlc_l) - (txp - txp_l))"])
    lags = ", ".join(f"{lag(c, 12)} AS {c}_l" for c in ("act", "che", "lct", "dlc", "txp"))
    table_case("join__chforecast_accrual_signal", "chforecast_accrual_signal()", sm, f"{_SPINE}, c AS (SELECT e, m, max(act) AS act, max(che) AS che, max(lct) AS lct, max(dlc) AS dlc, max(txp) AS txp, max(statement_month.\"at\") AS ta FROM statement_month GROUP BY e, m), l AS (SELECT *, {lags}, {lag('ta', 12)} AS ta_l FROM c), a AS (SELECT e, m, ({diff}) / nullif((ta + ta_l) / 2, 0) AS ac FROM l), est AS (SELECT ticker, m, max(meanest) AS est FROM estimates WHERE fpi = '1' GROUP BY ticker, m), j AS (SELECT a.e, a.m, ac, est FROM a LEFT JOIN (SELECT e, m, min(ticker) AS ticker FROM universe WHERE ticker IS NOT NULL GROUP BY e, m) t ON a.e = t.e AND a.m = t.m LEFT JOIN est ON t.ticker = est.ticker AND a.m = est.m), q AS (SELECT *, quantile_cont(ac, 0.5) OVER (PARTITION BY m) AS med, min(ac) OVER (PARTITION BY m) AS lo, max(ac) OVER (PARTITION BY m) AS hi, lag(est) OVER (PARTITION BY e ORDER BY m) AS pe FROM j), z AS (SELECT e, m, CASE WHEN est > pe THEN 1 WHEN est < pe THEN 0 END AS v FROM q WHERE NOT coalesce(lo < hi AND NOT (med > lo AND med < hi AND med < ac), false))")
    table_case("join__fgr5yr_lag_signal", "fgr5yr_lag_signal()", sm, f"{_SPINE}, {_TICKERS}, c AS (SELECT DISTINCT e, m FROM statement_month WHERE ceq IS NOT NULL AND ib IS NOT NULL AND txdi IS NOT NULL AND dv IS NOT NULL AND sale IS NOT NULL AND ni IS NOT NULL AND dp IS NOT NULL), r AS (SELECT e, m, max(meanest) AS x FROM c JOIN tickers USING (e, m) JOIN estimates USING (ticker, m) WHERE fpi = '0' GROUP BY e, m), l AS (SELECT e, m, {lag('x', 6)} AS v FROM r), stamped AS (SELECT e, m, v FROM l WHERE m % 12 = 5 AND v IS NOT NULL), {_held(12)}")
    table_case("join__sfe_signal", "sfe_signal()", sm, f"{_SPINE}, c AS (SELECT DISTINCT e, m FROM statement_month WHERE month(datadate) = 12), j AS (SELECT c.e, c.m, medest, numest, u.prc FROM estimates x JOIN universe u ON u.ticker = x.ticker AND u.m + 3 = x.m JOIN c ON c.e = u.e AND c.m = x.m WHERE fpi = '1' AND month(statpers) = 3 AND fpedats > statpers + 90), q AS (SELECT *, quantile_cont(numest, 0.5) OVER (PARTITION BY m) AS med, min(numest) OVER (PARTITION BY m) AS lo, max(numest) OVER (PARTITION BY m) AS hi FROM j), stamped AS (SELECT e, m, max(medest / abs(prc)) AS v FROM q WHERE lo < hi AND NOT (med > lo AND med < hi AND med < numest) GROUP BY e, m), {_held(12)}")
    table_case("event__earnings_streak_signal", "earnings_streak_signal()", [*u, "estimates_adjusted"], f"{_SPINE}, {_TICKERS}, a AS (SELECT ticker, {_month('anndats_act')} AS m, arg_max((actual - meanest) / price, anndats_act) AS x, max(anndats_act) AS d FROM estimates_adjusted WHERE fpi = '6' AND actual IS NOT NULL AND meanest IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, lag(sign(x)) OVER (PARTITION BY ticker ORDER BY d) AS l FROM a), k AS (SELECT ticker, m, x, m AS stamp FROM b WHERE sign(x) = l), p AS (SELECT t.e, t.m, k.x, k.stamp FROM tickers t LEFT JOIN k ON t.ticker = k.ticker AND t.m = k.m), f AS (SELECT e, m, {so_far('last_value(x IGNORE NULLS)')} AS x, {so_far('last_value(stamp IGNORE NULLS)')} AS stamp FROM p), z AS (SELECT e, m, x AS v FROM f WHERE m - stamp <= 6)")
    regular = "paid0 AS (SELECT e, m, arg_min(d, c) AS d, min(c) AS c FROM (SELECT e, m, cd3 AS c, sum(divamt) AS d FROM distributions WHERE cd1 = 1 AND cd2 = 2 GROUP BY e, m, cd3) GROUP BY e, m), flags AS (SELECT e, m, bool_or(shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3)) AS strict, max(prc) AS prc FROM stock_month GROUP BY e, m), g0 AS (SELECT s.e, s.m, coalesce(strict, false) AS strict, prc, d, c FROM spine s LEFT JOIN flags USING (e, m) LEFT JOIN paid0 USING (e, m)), grid AS (SELECT *, CASE WHEN strict THEN c END AS cs FROM g0), gc AS (SELECT *, " + so_far("last_value(cs IGNORE NULLS)") + " AS carried FROM grid)"
    passes = ", ".join(f"NOT coalesce({lag('pd', k)} <= 0, false) AS p{k}" for k in (2, 5, 8, 11))
    table_case("event__seasonal_dividend_indicator", "seasonal_dividend_indicator()", dt, f"{_SPINE}, {regular}, k AS (SELECT *, strict AND carried IS NOT NULL AND carried <> 2 AND carried < 6 AS keep FROM gc), s AS (SELECT *, CASE WHEN keep THEN CASE WHEN coalesce(d, 0) > 0 THEN 1.0 ELSE 0 END END AS pd, m BETWEEN min(CASE WHEN keep THEN m END) OVER (PARTITION BY e) AND max(CASE WHEN keep THEN m END) OVER (PARTITION BY e) AS inside FROM k), q AS (SELECT *, {passes}, {frame('sum(pd)', 11)} AS recent, CASE WHEN strict THEN carried END AS code FROM s), z AS (SELECT e, m, CASE WHEN inside THEN CASE WHEN (coalesce(code IN (0, 1, 3), false) AND (p2 OR p5 OR p8 OR p11)) OR (coalesce(code = 4, false) AND (p5 OR p11)) OR (coalesce(code = 5, false) AND p11) THEN 1 WHEN recent > 0 THEN 0 END END AS v FROM q)")
    yields = regular.replace("cd2 = 2 GROUP", "cd2 = 2 AND cd3 IN (3, 4, 5) GROUP")
    table_case("event__divyieldst_signal", "divyieldst_signal(D.divamt, D.distcd, C.prc)", dt, f"{_SPINE}, {yields}, a AS (SELECT *, CASE WHEN strict THEN coalesce(d, 0) END AS d0, CASE WHEN strict THEN carried END AS code FROM gc), b AS (SELECT *, {lag('d0', 2)} AS l2, {lag('d0', 5)} AS l5, {lag('d0', 11)} AS l11, {frame('sum(d0)', 11)} AS year FROM a), r AS (SELECT *, CASE WHEN year > 0 AND strict THEN CASE WHEN code = 4 THEN l5 WHEN code = 5 THEN l11 ELSE l2 END / nullif(abs(prc), 0) END AS r FROM b), x AS (SELECT *, CASE WHEN r > 0 THEN r END AS x FROM r), q AS (SELECT *, list_distinct([quantile_cont(x, 1 / 3) OVER (PARTITION BY m), quantile_cont(x, 2 / 3) OVER (PARTITION BY m)]) AS cuts, min(x) OVER (PARTITION BY m) AS lo, max(x) OVER (PARTITION BY m) AS hi FROM x), z AS (SELECT e, m, CASE WHEN r = 0 THEN 0 WHEN x IS NOT NULL AND lo < hi THEN 1 + len(list_filter(cuts, lambda v: v > lo AND v < hi AND v < x)) END AS v FROM q)")
    CASES.update(_values())
    CASES["join__rd_ability_signal"] = _ability()
    CASES["join__ms_signal"] = _ms()
    CASES["event__announcement_return_signal"] = _announcements()
    # Solutions of least norm, and collinear regressors: held against numpy in tests/test_kernels.py.
    for name, formula in {
        "join__abnormal_accruals_signal": "abnormal_accruals_signal()",
        "join__predicted_forecast_error": "predicted_forecast_error(growth_rows=24)",
        "regress__frontier_signal": "frontier_signal(A.at, A.ceq, A.dltt, A.capx, A.sale, A.xrd, A.xad, A.ppent, A.ebitda, C.mve_permco, industry48(C.sicCRSP))",
        "regress__intangible_residual": "intangible_residual(C.prc, C.ret)",
        "regress__trendfactor_signal": "trendfactor_signal(windows=[3, 5, 10, 20, 50])",
    }.items():
        rows_only(name, formula)


def valuation(growth_rows: int = 60) -> str:
    """CTEs up to june(e, m, value, optimism, roe, froe1, sg, bm, ltg): the analysts' values of each June."""
    div = lambda a, b: f"({ratio(a, b)})"
    estimate = lambda name, fpi, more, shift: f"{name} AS (SELECT ticker, CAST(m + {shift} AS INT) AS m, max(meanest) AS {name} FROM estimates WHERE fpi = '{fpi}'{more} GROUP BY 1, 2)"
    may = " AND month(statpers) = 5"
    steps = [
        ("ca", "CASE WHEN ceq_l IS NULL THEN ceq ELSE (ceq + ceq_l) / 2 END, shrout * prc AS me"),
        ("roe", f"{div('ibcom', 'ca')}, {div('feps1 * shrout', 'ca')} AS froe1, CASE WHEN ibcom < 0 THEN {div('dvc', '0.06 * ta')} ELSE {div('dvc', 'ibcom')} END AS k"),
        ("b1", "ceq * (1 + froe1 * (1 - k)), ceq * (1 + roe * (1 - k)) AS h1"),
        ("f2", f"{div('feps2 * shrout', '(b1 + ceq) / 2')}, b1 * (1 + froe1 * (1 - k)) AS b2, h1 * (1 + roe * (1 - k)) AS h2"),
        ("f3", f"CASE WHEN ltg IS NULL THEN f2 ELSE {div('feps2 * (1 + ltg / 100) * shrout', '(b1 + b2) / 2')} END, b2 * (1 + f2 * (1 - k)) AS b3"),
        ("av", f"{div('b1 + (froe1 - 0.12) / 1.12 * b1 + (f2 - 0.12) / (1.12 * 1.12) * b2 + (f3 - 0.12) / (1.12 * 1.12) / 0.12 * b3', 'me')}, {div('h1 + (roe - 0.12) / 1.12 * h1 + (roe - 0.12) / 1.12 / 0.12 * h2', 'me')} AS iv"),
    ]
    out = f"""{estimate('feps1', '1', may + ' AND fpedats > statpers + 30', 1)}, {estimate('feps2', '2', may, 1)}, {estimate('ltg', '0', '', 0)},
shares AS (SELECT e, m, max(shrout) AS shrout FROM stock_month GROUP BY e, m),
stated AS (SELECT e, m, datadate, ceq, ibcom, sale, dvc, statement_month."at" AS ta FROM statement_month),
v0 AS (SELECT u.e, u.m, u.ticker, abs(u.prc) AS prc, shrout, datadate, ceq, ibcom, dvc, ta, {div('sale', f'lag(sale, {growth_rows}) OVER (PARTITION BY u.e ORDER BY u.m)')} AS sg FROM universe u LEFT JOIN shares USING (e, m) LEFT JOIN stated USING (e, m)),
v1 AS (SELECT v0.*, lag(ceq) OVER (PARTITION BY e ORDER BY m) AS ceq_l FROM v0 WHERE m % 12 = 5),
v2 AS (SELECT v1.*, feps1, feps2, ltg FROM v1 LEFT JOIN feps1 USING (ticker, m) LEFT JOIN feps2 USING (ticker, m) LEFT JOIN ltg USING (ticker, m))"""
    last = "v2"
    for k, (name, expr) in enumerate(steps):
        out += f",\nw{k} AS (SELECT *, {_aliased(expr, name)} FROM {last})"
        last = f"w{k}"
    nothing = "CASE WHEN ibcom < 0 THEN dvc IS NULL OR ta IS NULL ELSE dvc IS NULL OR ibcom IS NULL END"
    screen = f"ceq > 0 AND (coalesce(abs(roe) <= 1, false) OR ibcom IS NULL) AND (coalesce(abs(froe1) <= 1, false) OR shrout IS NULL) AND (coalesce(k <= 1, false) OR {nothing}) AND month(datadate) >= 6 AND feps1 IS NOT NULL AND feps2 IS NOT NULL"
    return f"{out},\njune AS (SELECT e, m, av AS value, {div('av - iv', 'abs(iv)')} AS optimism, roe, froe1, sg, {div('ceq', 'me')} AS bm, ltg FROM {last} WHERE {screen})"


def _aliased(expr: str, name: str) -> str:
    """``name`` put behind the first of several select expressions (further ones have theirs)."""
    depth = 0
    for i, c in enumerate(expr):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            return f"{expr[:i]} AS {name}{expr[i:]}"
    return f"{expr} AS {name}"


VALUATION_TABLES = ["stock_month", "universe", "estimates", "statement_month"]


def _values() -> dict[str, tuple[str, str]]:
    out = {}
    for name, formula, column in (("join__analyst_value_signal", "analyst_value_signal()", "value"), ("join__analyst_optimism_ratio", "analyst_optimism_ratio()", "optimism")):
        table_case(name, formula, VALUATION_TABLES, f"{_SPINE}, {valuation()}, z AS (SELECT e, CAST(m + k AS INT) AS m, {column} AS v FROM june, range(0, 12) t(k))")
        out[name] = CASES[name]
    return out


def _ability() -> tuple[str, str]:
    body = f"{_SPINE}, a AS (SELECT firm, e, m, datadate, fyear, xrd, CASE WHEN sale > 0 THEN sale END AS s, CASE WHEN xrd >= 0 THEN xrd END AS r FROM statement_year), b AS (SELECT *, ln(s / lag(s) OVER w) AS y, ln(1 + r / s) AS x, fyear - row_number() OVER w AS run FROM a WINDOW w AS (PARTITION BY firm ORDER BY fyear))"
    lags = ", ".join(f"(SELECT o.x FROM b o WHERE o.firm = b.firm AND o.fyear = b.fyear - {n}) AS x{n}" for n in range(1, 6))
    body += f", c AS (SELECT *, {lags} FROM b)"
    slope = lambda n: f"(SELECT CASE WHEN count(*) >= 3 AND min(o.x{n}) < max(o.x{n}) THEN regr_slope(o.y, o.x{n}) END FROM c o WHERE o.firm = c.firm AND o.fyear BETWEEN c.fyear - 4 AND c.fyear AND o.y IS NOT NULL AND o.x{n} IS NOT NULL)"
    rare = lambda n: f"(SELECT count(*) >= 3 AND avg(CASE WHEN o.x{n} > 0 THEN 1.0 ELSE 0 END) < 0.5 FROM c o WHERE o.firm = c.firm AND o.run = c.run AND o.fyear BETWEEN c.fyear - 4 AND c.fyear)"
    body += ", d AS (SELECT *, " + ", ".join(f"CASE WHEN NOT {rare(n)} THEN {slope(n)} END AS g{n}" for n in range(1, 6)) + " FROM c)"
    body += ", f AS (SELECT firm, e, m, datadate, list_avg(list_filter([g1, g2, g3, g4, g5], lambda v: v IS NOT NULL)) AS g, CASE WHEN xrd > 0 THEN xrd / s END AS i FROM d)"
    body += ", q AS (SELECT *, list_distinct([quantile_cont(i, 1 / 3) OVER (PARTITION BY m), quantile_cont(i, 2 / 3) OVER (PARTITION BY m)]) AS cuts, min(i) OVER (PARTITION BY m) AS lo, max(i) OVER (PARTITION BY m) AS hi FROM f)"
    body += ", stamped AS (SELECT e, m, CASE WHEN i IS NOT NULL AND lo < hi AND 1 + len(list_filter(cuts, lambda v: v > lo AND v < hi AND v < i)) = 3 THEN g END AS v FROM q), "
    table_case("join__rd_ability_signal", "rd_ability_signal(years=5, min_pairs=3)", ["stock_month", "statement_year"], body + _held(12))
    return CASES["join__rd_ability_signal"]


def _ms() -> tuple[str, str]:
    """The sample first, then everything over its rows alone."""
    q = lambda c: f"CASE WHEN fqtr = 1 THEN {c} WHEN fqtr > 1 THEN {c} - lag({c}, 3) OVER w END AS {c}q"
    year = lambda c: f"CASE WHEN count({c}) OVER y = 12 THEN 4 * avg({c}) OVER y END"
    sd = lambda c: f"CASE WHEN count({c}) OVER f >= 18 THEN stddev_samp({c}) OVER f END"
    top = lambda c: f"coalesce({c}, CAST('inf' AS DOUBLE))"
    median = lambda c: top(f"median({c}) OVER g")
    div = lambda a, b: f"({ratio(a, b)})"
    owner = "owner AS (SELECT firm, m, min(e) AS e FROM universe WHERE firm IS NOT NULL GROUP BY firm, m), qs AS (SELECT o.e, o.m, max(niq) AS niq, max(atq) AS atq, max(saleq) AS saleq, max(oancfy) AS oancfy, max(capxy) AS capxy, max(xrdq) AS xrdq, max(fqtr) AS fqtr FROM statement_quarter s JOIN owner o ON s.firm = o.firm AND s.m = o.m GROUP BY o.e, o.m)"
    finite = lambda x: f"CASE WHEN abs({x}) < CAST('inf' AS DOUBLE) THEN {x} END"
    body = f"""{_SPINE}, {owner},
st AS (SELECT e, m, max(datadate) AS datadate, max(ceq) AS ceq, max(fopt) AS fopt, max(wcapch) AS wcapch, max(xad) AS xad FROM statement_month GROUP BY e, m),
sk AS (SELECT e, m, max(mve_permco) AS me, max(sicCRSP) AS sic FROM stock_month GROUP BY e, m HAVING bool_or(shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3))),
a AS (SELECT sk.*, st.* EXCLUDE (e, m), CASE WHEN me > 0 THEN ln(ceq / me) END AS bm FROM sk JOIN st USING (e, m) WHERE ceq > 0),
b AS (SELECT *, quantile_cont(bm, 0.2) OVER (PARTITION BY m) AS c1, min(bm) OVER (PARTITION BY m) AS lo, max(bm) OVER (PARTITION BY m) AS hi FROM a),
c AS (SELECT *, substr(CAST(CAST(floor(sic) AS BIGINT) AS VARCHAR), 1, 2) AS ind FROM b WHERE bm IS NOT NULL AND lo < hi AND NOT (c1 > lo AND c1 < hi AND c1 < bm)),
d AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ind, m) AS n FROM c WHERE ind IS NOT NULL) WHERE n >= 3),
k AS (SELECT d.*, niq, atq, saleq, oancfy, capxy, coalesce(xrdq, 0) AS xrdq, fqtr FROM d LEFT JOIN qs USING (e, m)),
k1 AS (SELECT *, {q('capxy')}, {q('oancfy')}, lag(atq, 3) OVER w AS old, {div('saleq', 'lag(saleq, 3) OVER w')} AS sg0, {div('niq', 'atq')} AS rq0 FROM k WINDOW w AS (PARTITION BY e ORDER BY m)),
k2 AS (SELECT *, {finite('sg0')} AS sg, {finite('rq0')} AS rq FROM k1),
k3 AS (SELECT *, {year('niq')} AS ni, {year('xrdq')} AS xr, {year('capxyq')} AS cx, CASE WHEN year(datadate) <= 1988 THEN fopt - wcapch ELSE {year('oancfyq')} END AS cf, {sd('rq')} AS v1, {sd('sg')} AS v2 FROM k2 WINDOW y AS (PARTITION BY e ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW), f AS (PARTITION BY e ORDER BY m RANGE BETWEEN 47 PRECEDING AND CURRENT ROW)),
k4 AS (SELECT *, {div('ni', '(atq + old) / 2')} AS a1, {div('cf', '(atq + old) / 2')} AS a2, {div('xr', 'old')} AS a3, {div('cx', 'old')} AS a4, {div('coalesce(xad, 0)', 'old')} AS a5 FROM k3),
k5 AS (SELECT *, {' + '.join(f"CASE WHEN {top(x)} > {median(x)} THEN 1 ELSE 0 END" for x in ('a1', 'a2', 'a3', 'a4', 'a5'))} + {' + '.join(f"CASE WHEN {top(x)} < {median(x)} THEN 1 ELSE 0 END" for x in ('v1', 'v2'))} + CASE WHEN {top('cf')} > {top('ni')} THEN 1 ELSE 0 END AS score FROM k4 WINDOW g AS (PARTITION BY ind, m)),
k6 AS (SELECT *, CASE WHEN NOT coalesce(m % 12 + 1 <> (month(datadate) + 6) % 12, false) THEN least(greatest(score, 1), 6) END AS told FROM k5),
z AS (SELECT e, m, {so_far('last_value(told IGNORE NULLS)')} AS v FROM k6)"""
    table_case("join__ms_signal", MS, ["stock_month", "statement_month", "statement_quarter", "universe"], body)
    return CASES["join__ms_signal"]


def _announcements() -> tuple[str, str]:
    """Each trading row goes to the announcement that claims it last: itself, the next row's, the one after, the one before."""
    body = f"""{_SPINE},
k AS (SELECT DISTINCT firm, e, first_day, coalesce(last_day, DATE '2999-12-31') AS last_day FROM links),
ev AS (SELECT DISTINCT k.e, s.rdq AS d FROM (SELECT DISTINCT firm, rdq FROM statement_quarter WHERE rdq IS NOT NULL) s JOIN k ON s.firm = k.firm AND s.rdq BETWEEN first_day AND last_day),
alive AS (SELECT DISTINCT s.e, s.d, s.ret FROM stock_day s JOIN k ON s.e = k.e AND s.d BETWEEN first_day AND last_day),
r AS (SELECT a.e, a.d, ret - mktrf - rf AS x, row_number() OVER (PARTITION BY a.e ORDER BY a.d) AS i, ev.e IS NOT NULL AS ann FROM alive a JOIN factors_day f ON a.d = f.d LEFT JOIN ev ON ev.e = a.e AND ev.d = a.d),
o AS (SELECT e, d, x, CASE WHEN coalesce(lag(ann) OVER w, false) THEN i - 1 WHEN coalesce(lead(ann, 2) OVER w, false) THEN i + 2 WHEN coalesce(lead(ann) OVER w, false) THEN i + 1 WHEN ann THEN i END AS t FROM r WINDOW w AS (PARTITION BY e ORDER BY i)),
g AS (SELECT e, t, coalesce(sum(x), 0) AS v, {_month('max(d)')} AS m FROM o WHERE t IS NOT NULL GROUP BY e, t),
stamped AS (SELECT e, m, arg_max(v, t) AS v, max(m) OVER (PARTITION BY e) AS fin FROM g GROUP BY e, m),
z AS (SELECT e, m, v FROM (SELECT e, CAST(m + k AS INT) AS m, v, fin, row_number() OVER (PARTITION BY e, m + k ORDER BY k) AS rn FROM stamped, range(0, 7) t(k)) WHERE rn = 1 AND m <= fin)"""
    table_case("event__announcement_return_signal", "announcement_return_signal()", ["stock_month", "stock_day", "factors_day", "links", "statement_quarter"], body)
    return CASES["event__announcement_return_signal"]


def tree(name: str) -> Expr:
    return parse(CASES[name][0], shared(), DATASETS)


_fill()
