"""SQL of regressions on several variables, by orthogonalising one regressor after the other.

SQL knows slopes on one variable.  Regressors are replaced, in order, by what is left of them beside those before; on such
parts the slopes of a regression are those of one variable each, and fitted values are their sum.  The slope on the last
part is the coefficient of the last regressor.  No moments, no solver: nothing is shared with the library's way.
"""

from __future__ import annotations

from cadenza.oracles.kernels import _DAYS, _SPINE, table_case
from cadenza.oracles.panel import frame, ratio


def parts(source: str, prefix: str, keys: str, y: str, xs: list[str], fit: str = "true") -> str:
    """CTEs ``{prefix}_1`` and on; the last one, ``{prefix}_z``, adds r1.. (parts), s1.. (slopes of y) and fitted.

    Rows for which ``fit`` is false are scored by the others of their group.
    """
    rows = f"FILTER (WHERE {fit}) OVER (PARTITION BY {keys})"
    out = f"{prefix}_0 AS (SELECT *, {', '.join(f'{x} - avg({x}) {rows} AS r{i}' for i, x in enumerate(xs, 1))}, {y} - avg({y}) {rows} AS ry, avg({y}) {rows} AS my FROM {source})"
    step = 0
    for i in range(2, len(xs) + 1):
        for j in range(1, i):
            out += f", {prefix}_{step + 1} AS (SELECT * REPLACE (r{i} - (regr_sxy(r{i}, r{j}) {rows} / nullif(regr_sxx(r{i}, r{j}) {rows}, 0)) * r{j} AS r{i}) FROM {prefix}_{step})"
            step += 1
    slopes = ", ".join(f"regr_sxy(ry, r{i}) {rows} / nullif(regr_sxx(ry, r{i}) {rows}, 0) AS s{i}" for i in range(1, len(xs) + 1))
    out += f", {prefix}_s AS (SELECT *, {slopes}, count(*) {rows} AS n_fit FROM {prefix}_{step})"
    fitted = " + ".join(f"s{i} * r{i}" for i in range(1, len(xs) + 1))
    return f"{out}, {prefix}_z AS (SELECT *, my + {fitted} AS fitted FROM {prefix}_s)"


def _trailing(source: str, rows: int, least: int) -> str:
    """``win``: for each row of source(e, m, i) from number ``least`` on, the rows up to it, under m0."""
    return f"win AS (SELECT a.m AS m0, b.* FROM {source} a JOIN {source} b ON a.e = b.e AND b.i BETWEEN a.i - {rows - 1} AND a.i WHERE a.i >= {least})"


def fill() -> None:
    daily = ["stock_month", "stock_day", "factors_day"]
    three = "v AS (SELECT e, m, ret - rf AS y, mktrf, smb, hml FROM days JOIN factors_day USING (d) WHERE ret IS NOT NULL AND mktrf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL)"
    body = f"{_SPINE}, {_DAYS}, {three}, {parts('v', 'o', 'e, m', 'y', ['mktrf', 'smb', 'hml'])}"
    table_case("regress__ff3_idio_std", "ff3_idio_stat(stat='std')", daily, f"{body}, z AS (SELECT e, m, stddev_samp(y - fitted) AS v FROM o_z WHERE n_fit >= 15 GROUP BY e, m)")
    skew = "avg(power(x - mx, 3)) / power(avg(power(x - mx, 2)), 1.5)"
    table_case("regress__ff3_idio_skew", "ff3_idio_stat(stat='skew')", daily, f"{body}, q AS (SELECT e, m, y - fitted AS x, avg(y - fitted) OVER (PARTITION BY e, m) AS mx FROM o_z WHERE n_fit >= 15), z AS (SELECT e, m, CASE WHEN stddev_pop(x) > 1e-10 THEN {skew} END AS v FROM q GROUP BY e, m)")

    monthly = ["stock_month", "factors_month", "liquidity_month"]
    stock = "rows AS (SELECT e, m, max(ret) AS ret FROM stock_month GROUP BY e, m)"
    valid = "v AS (SELECT e, m, ret - rf AS y, mktrf, smb, hml, ps_innov, row_number() OVER (PARTITION BY e ORDER BY m) AS i FROM rows JOIN factors_month USING (m) LEFT JOIN liquidity_month USING (m) WHERE ret IS NOT NULL AND mktrf IS NOT NULL"
    table_case("regress__residual_momentum", "residual_momentum(reg_window=36, mom_window=11)", monthly, f"{_SPINE}, {stock}, {valid}), {_trailing('v', 36, 36)}, {parts('win', 'o', 'e, m0', 'y', ['mktrf', 'smb', 'hml'])}, r AS (SELECT e, m, y - fitted AS r FROM o_z WHERE m = m0), g AS (SELECT s.e, s.m, r FROM spine s LEFT JOIN r USING (e, m)), z AS (SELECT e, m, CASE WHEN {frame('count(r)', 11, 1)} = 11 THEN {ratio(frame('avg(r)', 11, 1), frame('stddev_samp(r)', 11, 1))} END AS v FROM g)")
    carried = "j AS (SELECT rows.e, rows.m, b FROM rows LEFT JOIN b ON rows.e = b.e AND rows.m = b.m), z AS (SELECT e, m, last_value(b IGNORE NULLS) OVER (PARTITION BY e ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM j)"
    regressors = "['liquidity_month:ps_innov_pit', 'factors_month:mktrf', 'factors_month:hml', 'factors_month:smb']"
    table_case("regress__monthly_rolling_multibeta", f"monthly_rolling_multibeta(regressors={regressors}, keep=0, window=60, min_obs=36)", monthly, f"{_SPINE}, {stock}, {valid} AND ps_innov IS NOT NULL), {_trailing('v', 60, 36)}, {parts('win', 'o', 'e, m0', 'y', ['mktrf', 'hml', 'smb', 'ps_innov'])}, b AS (SELECT e, m0 AS m, max(s4) AS b FROM o_z GROUP BY e, m0), {carried}")

    names = [f"x{k}" for k in range(5)]
    lags = ", ".join(["mktrf AS x0", *(f"lag(mktrf, {k}) OVER (ORDER BY d) AS x{k}" for k in range(1, 5))])
    july = f"mk AS (SELECT d, rf, {lags} FROM factors_day), a AS (SELECT e, m, CAST(floor((m + 6) / 12) AS INT) AS b, ret - rf AS y, {', '.join(names)} FROM days JOIN mk USING (d)), ok AS (SELECT e, b FROM a GROUP BY e, b HAVING max(m) % 12 = 5 AND min(y) < max(y) AND min(x0) < max(x0)), v AS (SELECT a.* FROM a JOIN ok USING (e, b) WHERE y IS NOT NULL AND x4 IS NOT NULL)"
    held = "z AS (SELECT e, m, arg_max(v, b) AS v FROM (SELECT e, b, CAST(b * 12 + 6 + k AS INT) AS m, v FROM stamped, range(0, 12) t(k) WHERE v IS NOT NULL AND NOT isnan(v)) GROUP BY e, m)"
    rsq = f"{parts('v', 'o', 'e, b', 'y', names)}, stamped AS (SELECT e, b, 1 - (power(regr_sxy(y, x0), 2) / regr_sxx(y, x0) / regr_syy(y, x0)) / (1 - sum(power(y - fitted, 2)) / regr_syy(y, x0)) AS v FROM o_z WHERE n_fit >= 26 GROUP BY e, b)"
    table_case("regress__price_delay_rsq", "price_delay(stat='rsq')", daily, f"{_SPINE}, {_DAYS}, {july}, {rsq}, {held}")
    chains = ", ".join(parts("v", f"o{k}", "e, b", "y", [x for x in names if x != f"x{k}"] + [f"x{k}"]) for k in range(5))
    each = ", ".join(f"c{k} AS (SELECT e, b, max(s5) AS b{k}, sum(r5 * r5) AS w{k}, sum(power(y - fitted, 2)) AS rss, count(*) AS n FROM o{k}_z WHERE n_fit >= 26 GROUP BY e, b)" for k in range(5))
    joined = "c0" + "".join(f" JOIN c{k} USING (e, b)" for k in range(1, 5))
    for stat, weight in (("slope", lambda k: f"b{k}"), ("tstat", lambda k: f"b{k} / sqrt(c0.rss / (c0.n - 6) / w{k})")):
        table_case(f"regress__price_delay_{stat}", f"price_delay(stat='{stat}')", daily, f"{_SPINE}, {_DAYS}, {july}, {chains}, {each}, stamped AS (SELECT e, b, ({' + '.join(f'{k} * ({weight(k)})' for k in range(1, 5))}) / ({' + '.join(f'({weight(k)})' for k in range(5))}) AS v FROM {joined}), {held}")

    def coskew(source: str, months: int, least: int) -> str:
        whole = f"wn AS (SELECT a.e, a.m AS m0, b.x, CASE WHEN b.x IS NOT NULL THEN b.y END AS y FROM (SELECT DISTINCT e, m FROM {source}) a JOIN {source} b ON a.e = b.e AND b.m BETWEEN a.m - {months - 1} AND a.m)"
        return f"{whole}, ms AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, var_pop(x) OVER w AS vx FROM wn WINDOW w AS (PARTITION BY e, m0)), cs AS (SELECT e, m0 AS m, count(y) AS n, avg((y - my) * power(x - mx, 2)) / (sqrt(var_pop(y)) * max(vx)) AS v FROM ms GROUP BY e, m0 HAVING count(y) >= {least} AND var_pop(y) > 1e-14 AND max(vx) > 1e-14)"

    table_case("regress__coskew_monthly", "coskew_signal(variant='monthly')", monthly, f"{_SPINE}, {stock}, src AS (SELECT e, m, ret - rf AS y, mktrf AS x FROM rows JOIN factors_month USING (m)), {coskew('src', 60, 12)}, z AS (SELECT e, m, v FROM cs)")
    table_case("regress__coskew_daily", "coskew_signal(variant='daily')", daily, f"{_SPINE}, {_DAYS}, src AS (SELECT e, m, ln(1 + ret) - ln(1 + rf) AS y, ln(1 + mktrf + rf) - ln(1 + rf) AS x FROM days JOIN factors_day USING (d)), {coskew('src', 12, 1)}, z AS (SELECT e, m, v FROM (SELECT *, max(n) OVER (PARTITION BY m) AS most FROM cs) WHERE most - n <= 5)")
    rows = lambda fn, c, n, least: f"CASE WHEN count({c}) OVER w{n} >= {least} THEN {fn}({c}) OVER w{n} END"
    three_day = lambda c: f"{c} + lag({c}, 1) OVER d + lag({c}, 2) OVER d AS {c}3"
    corr = ratio(f"{rows('avg', 'xy', 1260, 500)} - ({rows('avg', 'x3', 1260, 500)}) * ({rows('avg', 'y3', 1260, 500)})", f"({rows('stddev_samp', 'x3', 1260, 500)}) * ({rows('stddev_samp', 'y3', 1260, 500)})")
    vol = ratio(f"({rows('stddev_samp', 'y', 252, 120)})", f"({rows('stddev_samp', 'x', 252, 120)})")
    table_case("regress__betafp_signal", "betafp_signal()", daily, f"{_SPINE}, {_DAYS}, a AS (SELECT e, m, d, ln(1 + ret) AS y, ln(1 + mktrf) AS x FROM days JOIN factors_day USING (d)), b AS (SELECT *, {three_day('y')}, {three_day('x')} FROM a WINDOW d AS (PARTITION BY e ORDER BY d)), c AS (SELECT *, x3 * y3 AS xy FROM b), f AS (SELECT e, m, d, abs({corr}) * ({vol}) AS v FROM c WINDOW w1260 AS (PARTITION BY e ORDER BY d ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY e ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)), z AS (SELECT e, m, arg_max(v, d) AS v FROM f WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY e, m)")


fill()
