"""One query for each operator on the stand-in panel, with SQL written independently of the compiler.

``CASES`` maps a query name to a formula and to the SQL of the same value over view ``p``: the spine joined with every
leaf.  SQL that needs a value of another window is split into steps, (name, expression) pairs, each a CTE over the last.
"""

from __future__ import annotations

import re

from cadenza.plans.catalog import DATASETS, shared
from cadenza.plans.expr import Expr, parse
from cadenza.sources.standins import duckdb_with

#: Columns of the leaves that the SQL below uses.
STOCK = "vol ret prc shrout cfacshr exchcd shrcd sicCRSP mve_c mve_permco".split()
STATEMENT = """aco act ao ap at capx ceq che cogs dc cshrc dlc dltt dp drc dv dvc emp epspx fincf ib intan invt ivao ivncf ivst lco lct lo lt ni oancf oibdp
ppent prstkc pstk pstkl pstkrv rect revt sale seq sstk txdi txditc txfed txfo txt xrd fopt xint""".split()


#: Rounding to six places, with ties where no short decimal lies, so that engines agree.
ROUNDED = "CASE WHEN abs(v) < 1e12 THEN floor(v * 1e6 + 0.50123e0) / 1e6 ELSE v END"


def _max(columns: list[str], alias: str) -> str:
    return ", ".join(f"max({alias}.{c}) AS {c}" for c in columns)


def base(reach: int, statement: list[str] = STATEMENT) -> str:
    """CTEs up to ``p``: spine months up to ``reach`` after an entity's last, flags, and leaf columns."""
    tables = duckdb_with("stock_month", "statement_month", "universe")
    return f"""WITH {tables},
seen AS (SELECT e, m, bool_or(coalesce(shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3), false)) AS strict, {_max(STOCK, 'stock_month')} FROM stock_month GROUP BY e, m),
ends AS (SELECT e, min(m) AS lo, max(m) AS hi FROM seen GROUP BY e),
months AS (SELECT e, CAST(unnest(range(lo, least(hi + {reach}, (SELECT max(hi) FROM ends)) + 1)) AS INT) AS m FROM ends),
stated AS (SELECT e, m, max(sic) AS sic, max(sich) AS sich, max(year(datadate) * 12 + month(datadate) - 1) AS datadate, {_max(statement, 'statement_month')} FROM statement_month GROUP BY e, m),
firms AS (SELECT DISTINCT e, m FROM universe WHERE firm IS NOT NULL),
p AS (SELECT a.e, a.m, coalesce(b.strict, false) AS strict, b.e IS NOT NULL AS listed, c.e IS NOT NULL AS compustat, d.e IS NOT NULL AS linked, {', '.join('b.' + x for x in STOCK)}, c.sic, c.sich, c.datadate, {', '.join('c.' + x for x in statement)}
  FROM months a LEFT JOIN seen b ON a.e = b.e AND a.m = b.m LEFT JOIN stated c ON a.e = c.e AND a.m = c.m LEFT JOIN firms d ON a.e = d.e AND a.m = d.m)"""


def steps(reach: int, value: str, *before: tuple[str, str]) -> str:
    """SQL of (e, m, value), rounded, present values only; infinities and NaN follow the library's rules."""
    out, last = base(reach), "p"
    for k, (name, expr) in enumerate(before):
        out += f",\ns{k} AS (SELECT *, {expr} AS {name} FROM {last})"
        last = f"s{k}"
    out = f"{out},\nz AS (SELECT e, m, CAST({value} AS DOUBLE) AS v FROM {last})\nSELECT e, m, {ROUNDED} AS value FROM z WHERE v IS NOT NULL AND NOT isnan(v)"
    return sql_names(out)


def sql_names(sql: str) -> str:
    """``at`` is a keyword there."""
    return re.sub(r'(?<![\w."])at(?![\w"])', '"at"', sql)


def lag(x: str, n: int) -> str:
    return f"max({x}) OVER (PARTITION BY e ORDER BY m RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


def frame(fn: str, first: int, last: int = 0) -> str:
    """Aggregate over months m - first to m - last."""
    return f"{fn} OVER (PARTITION BY e ORDER BY m RANGE BETWEEN {first} PRECEDING AND {last} PRECEDING)"


def so_far(fn: str) -> str:
    return f"{fn} OVER (PARTITION BY e ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN CAST('inf' AS DOUBLE) WHEN ({b}) = 0 AND ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END"


def log(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) WHEN ({x}) = 0 THEN CAST('-inf' AS DOUBLE) END"


def number(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def fin(x: str) -> str:
    return f"CASE WHEN abs({x}) < CAST('inf' AS DOUBLE) THEN {x} END"


def qcut(x: str, n: int, month: str = "m") -> str:
    """Bins of column x as one expression over steps that hold x already."""
    cuts = "[" + ", ".join(f"quantile_cont({x}, {k / n}) OVER (PARTITION BY {month})" for k in range(1, n)) + "]"
    low, high = f"min({x}) OVER (PARTITION BY {month})", f"max({x}) OVER (PARTITION BY {month})"
    return f"CASE WHEN {x} IS NOT NULL AND {low} < {high} THEN 1 + len(list_filter(list_distinct({cuts}), lambda v: v > lo AND v < hi AND v < {x})) END".replace("lo ", f"{low} ").replace("hi ", f"{high} ")


def qcut_steps(name: str, x: str, n: int) -> list[tuple[str, str]]:
    """Steps that end in column ``name``: bins of column x."""
    cuts = "list_value(" + ", ".join(f"quantile_cont({x}, {k / n}) OVER (PARTITION BY m)" for k in range(1, n)) + ")"
    return [(f"{name}_c", cuts), (f"{name}_l", f"min({x}) OVER (PARTITION BY m)"), (f"{name}_h", f"max({x}) OVER (PARTITION BY m)"), (name, f"CASE WHEN {x} IS NOT NULL AND {name}_l < {name}_h THEN 1 + len(list_filter(list_distinct({name}_c), lambda v: v > {name}_l AND v < {name}_h AND v < {x})) END")]


def fastxtile_steps(name: str, x: str, n: int) -> list[tuple[str, str]]:
    cuts = "list_value(" + ", ".join(f"quantile_cont({name}_x, {k / n}) OVER (PARTITION BY m)" for k in range(1, n)) + ")"
    w = "OVER (PARTITION BY m)"
    return [(f"{name}_x", fin(x)), (f"{name}_c", cuts), (f"{name}_l", f"min({name}_x) {w}"), (f"{name}_h", f"max({name}_x) {w}"), (f"{name}_n", f"count({name}_x) {w}"), (f"{name}_i", f"sum(CASE WHEN {name}_x > {name}_l AND {name}_x < {name}_h THEN 1 ELSE 0 END) {w}"),
            (name, f"CASE WHEN {name}_x IS NULL THEN NULL WHEN {name}_n < {n} OR {name}_l = {name}_h THEN 1 WHEN {name}_i = 0 THEN CASE WHEN {name}_x = {name}_l THEN 1 ELSE {n} END ELSE 1 + len(list_filter({name}_c, lambda v: {name}_x > v)) END")]


def span(flag: str) -> str:
    return f"m BETWEEN min(CASE WHEN {flag} THEN m END) OVER (PARTITION BY e) AND max(CASE WHEN {flag} THEN m END) OVER (PARTITION BY e)"


def compound(x: str, lags: list[int]) -> str:
    """All lags present, one run of lags."""
    a, b = min(lags), max(lags)
    return f"CASE WHEN {frame(f'count({x})', b, a)} = {b - a + 1} THEN {frame(f'product(1 + {x})', b, a)} - 1 END"


YEAR = "CAST(floor(m / 12) AS INT)"
_SIC2 = "substr(CAST(CAST(floor(sicCRSP) AS BIGINT) AS VARCHAR), 1, 2)"
_R0 = ("r", "CASE WHEN strict THEN coalesce(ret, 0) END")
_IN = ("inside", span("strict"))

Case = tuple[str, str]
CASES: dict[str, Case] = {}


def case(name: str, formula: str, value: str, *before: tuple[str, str]) -> None:
    tree = parse(formula, shared(), DATASETS)
    CASES[name] = (formula, steps(min(600, tree.reach), value, *before))


def _fill() -> None:
    # Elementwise.
    case("scalar__add", "A.at + A.lt", "at + lt")
    case("scalar__sub", "A.at - A.lt", "at - lt")
    case("scalar__mul", "C.prc * C.vol", "prc * vol")
    case("scalar__div", "A.at / A.sale", ratio("at", "sale"))
    case("scalar__log", "log(A.at)", log("at"))
    case("scalar__pow", "C.ret ** 2", "ret * ret")
    case("scalar__abs", "abs(C.prc)", "abs(prc)")
    case("scalar__max", "max(A.at, A.lt)", "CASE WHEN at IS NOT NULL AND lt IS NOT NULL THEN greatest(at, lt) END")
    case("scalar__fillna", "fillna(A.dlc, value=0)", "coalesce(dlc, 0)")
    case("scalar__coalesce", "coalesce(A.oancf, A.ib)", "coalesce(oancf, ib)")
    case("scalar__positive_only", "positive_only(A.ib)", "CASE WHEN ib > 0 THEN ib END")
    case("scalar__negative_to_null", "negative_to_null(A.ib)", "CASE WHEN ib >= 0 THEN ib END")
    case("scalar__zero_to_null", "zero_to_null(A.ib)", "nullif(ib, 0)")
    case("scalar__nonzero", "nonzero(A.ni)", "nullif(ni, 0)")
    case("scalar__positive_indicator", "positive_indicator(A.ib)", "CASE WHEN ib > 0 THEN 1 WHEN ib <= 0 THEN 0 END")
    case("scalar__abs_cap_to_null", "abs_cap_to_null(C.ret, max_abs=0.1)", "CASE WHEN abs(ret) <= 0.1 THEN ret END")
    case("scalar__threshold_min", "threshold_min(C.ret, C.vol, min_value=100.0)", "CASE WHEN vol >= 100 THEN ret END")
    case("scalar__year_filtered", "year_filtered(C.prc, min_year=1997, max_year=1999)", f"CASE WHEN {YEAR} BETWEEN 1997 AND 1999 THEN prc END")
    case("scalar__nonfinancial_only", "nonfinancial_only(C.prc, C.sicCRSP)", "CASE WHEN sicCRSP < 6000 OR sicCRSP >= 7000 THEN prc END")
    case("scalar__manufacturing_only", "manufacturing_only(A.at, sic_pit)", f"CASE WHEN {number('coalesce(sich, sic)')} BETWEEN 2000 AND 3999 THEN at END")
    case("scalar__financial_excluded", "financial_excluded(C.prc, C.sicCRSP)", "CASE WHEN NOT coalesce(sicCRSP >= 6000 AND sicCRSP < 7000, false) THEN prc END")
    case("scalar__shrcd_le11", "shrcd_le11(C.prc, C.shrcd)", "CASE WHEN NOT coalesce(shrcd > 11, false) THEN prc END")
    case("scalar__bm_defined_gate", "bm_defined_gate(A.at, A.ceq, C.mve_permco)", f"CASE WHEN ({log('q')}) IS NOT NULL THEN at END", ("q", ratio("ceq", "mve_permco")))
    case("scalar__deldrc_sample_filter", "deldrc_sample_filter(A.dp, A.drc, A.ceq, A.sale, A.sic)", f"CASE WHEN NOT (coalesce(ceq <= 0, false) OR (coalesce(drc = 0, false) AND coalesce(dp = 0, false)) OR coalesce(sale < 5, false) OR coalesce({number('sic')} >= 6000 AND {number('sic')} < 7000, false)) THEN dp END")
    case("scalar__convertible_debt_indicator", "convertible_debt_indicator(A.dc, A.cshrc)", "CASE WHEN dc IS NOT NULL OR cshrc IS NOT NULL THEN CASE WHEN coalesce(dc <> 0, false) OR coalesce(cshrc <> 0, false) THEN 1 ELSE 0 END END")
    case("scalar__enterprise_multiple", "enterprise_multiple(C.mve_permco, A.dltt, A.dlc, A.dc, A.che, A.oibdp, A.ceq)", f"CASE WHEN NOT (coalesce(ceq < 0, false) OR coalesce(oibdp < 0, false)) THEN {ratio('mve_permco + dltt + dlc + dc - che', 'oibdp')} END")
    rate = f"CASE WHEN {YEAR} >= 1993 THEN 0.35 WHEN {YEAR} >= 1988 THEN 0.34 WHEN {YEAR} = 1987 THEN 0.4 WHEN {YEAR} >= 1979 THEN 0.46 ELSE 0.48 END"
    some = "(coalesce(txt <> 0, false) OR coalesce(txdi <> 0, false))"
    case("scalar__piecewise_tax_ratio", "piecewise_tax_ratio(A.txfo, A.txfed, A.txt, A.txdi, A.ib)", fin("CASE WHEN one THEN 1 ELSE plain END"),
         ("tax", "CASE WHEN txfo IS NULL OR txfed IS NULL THEN txt - txdi ELSE txfo + txfed END"), ("plain", ratio(f"tax / CAST({rate} AS DOUBLE)", "ib")),
         ("one", f"(coalesce(ib = 0, false) AND (coalesce(txfo <> 0, false) OR coalesce(txfed <> 0, false) OR {some})) OR (coalesce(ib <= 0, false) AND (plain IS NULL OR coalesce(CASE WHEN txfed IS NULL THEN txfo > 0 ELSE txfo + txfed > 0 END, false) OR coalesce(txt > txdi, false) OR (txfo IS NULL AND txfed IS NULL AND {some})))"))
    case("scalar__surprise_rd_indicator", "surprise_rd_indicator(A.xrd, A.revt, A.at)", f"CASE WHEN xrd IS NOT NULL AND x12 IS NOT NULL THEN CASE WHEN coalesce({ratio('xrd', 'revt')} > 0 AND a > 0 AND {ratio('xrd', 'x12')} > 1.05 AND {ratio('a', 'a12')} > 1.05, false) THEN 1 ELSE 0 END END",
         ("x12", lag("xrd", 12)), ("a", ratio("xrd", "at")), ("a12", lag("a", 12)))
    # Time axis.
    case("time__lag", "C.prc[t-3]", lag("prc", 3))
    case("time__time_lagged_value", "time_lagged_value(C.shrout, months=6)", lag("shrout", 6))
    case("time__delta", "delta(C.prc, n=12)", f"prc - {lag('prc', 12)}")
    case("time__mean_of_lags", "mean_of_lags(C.ret, lags=[1,2,3,11,23])", "CASE WHEN n1 + n2 + n3 > 0 THEN (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / (n1 + n2 + n3) END",
         ("s1", frame("sum(ret)", 3, 1)), ("s2", lag("ret", 11)), ("s3", lag("ret", 23)), ("n1", frame("count(ret)", 3, 1)), ("n2", frame("count(ret)", 11, 11)), ("n3", frame("count(ret)", 23, 23)))
    case("time__compound_return", "compound_return(C.ret, lags=[1,2,3,4,5])", compound("ret", [1, 5]))
    case("time__compound_return_filled", "compound_return(C.ret, lags=[13,14,15], fill_missing=0)", compound("r0", [13, 15]), ("r0", "coalesce(ret, 0)"))
    case("time__require_any_lag", "require_any_lag(C.prc, C.ret, lags=[13,14,15])", f"CASE WHEN {frame('count(r1)', 15, 13)} > 0 THEN prc END", ("r1", "CASE WHEN strict THEN ret END"))
    case("time__ffill", "ffill(A.ppent)", so_far("last_value(ppent IGNORE NULLS)"))
    case("time__rolling_mean", "rolling_mean(C.vol, window_months=12, min_obs=10)", f"CASE WHEN {frame('count(vol)', 11)} >= 10 THEN {frame('avg(vol)', 11)} END")
    case("time__rolling_std", "rolling_std(C.ret, window_months=36, min_obs=24)", f"CASE WHEN {frame('count(ret)', 35)} >= 24 THEN {frame('stddev_samp(ret)', 35)} END")
    case("time__investment_to_sales_scaled", "investment_to_sales_scaled(A.capx, A.revt, window_months=36, min_obs=24)", f"CASE WHEN revt >= 10 THEN {ratio('q', 'mean')} END", ("q", ratio("capx", "revt")), ("mean", f"CASE WHEN {frame('count(q)', 35)} >= 24 THEN list_avg({frame('list(q) FILTER (WHERE q IS NOT NULL)', 35)}) END"))
    case("time__exchange_switch_indicator", "exchange_switch_indicator(C.exchcd, lookback_months=12)", "CASE WHEN exchcd IS NOT NULL THEN CASE WHEN (exchcd = 1 AND coalesce(a, 0) = 1) OR (exchcd = 2 AND coalesce(b, 0) = 1) THEN 1 ELSE 0 END END",
         ("a", frame("max(CASE WHEN exchcd IN (2, 3) THEN 1 ELSE 0 END)", 12, 1)), ("b", frame("max(CASE WHEN exchcd = 3 THEN 1 ELSE 0 END)", 12, 1)))
    case("time__market_equity_matched", "market_equity_matched_to_datadate(C.mve_permco, A.datadate, lag_months=6)", so_far("last_value(x IGNORE NULLS)"), ("x6", lag("mve_permco", 6)), ("x", "CASE WHEN datadate = m - 6 THEN x6 END"))
    level = "rect + invt + ppent + aco + intan + ao - ap - lco - lo"
    case("time__gr_ltnoa", "gr_ltnoa(A.rect, A.invt, A.ppent, A.aco, A.intan, A.ao, A.ap, A.lco, A.lo, A.at, A.dp)", f"l - l12 - ({ratio('w', '(at + at12) / 2')})",
         ("l", ratio(level, "at")), ("l12", lag("l", 12)), ("at12", lag("at", 12)), ("w", " + ".join(f"({x} - {lag(x, 12)})" for x in ("rect", "invt", "aco")) + " - " + " - ".join(f"({x} - {lag(x, 12)})" for x in ("ap", "lco")) + " - dp"))
    case("time__total_accruals_signal", "total_accruals_signal(A.ivao, A.ivst, A.dltt, A.dlc, A.pstk, A.sstk, A.prstkc, A.dv, A.act, A.che, A.lct, A.at, A.lt, A.ni, A.oancf, A.ivncf, A.fincf)", fin(ratio("ni - (oancf + ivncf + fincf) + (coalesce(sstk, 0) - coalesce(prstkc, 0) - coalesce(dv, 0))", "at12")), ("at12", lag("at", 12)))
    growth = [("e12", lag("epspx", 12)), ("e24", lag("epspx", 24)), ("q", ratio("epspx - e12", "0.5 * (abs(e12) + abs(e24))")), ("g", fin("q")), *((f"g{k}", lag("g", k)) for k in (12, 24, 36, 48))]
    terms = ["g", "g12", "g24", "g36", "g48"]
    case("time__earnings_consistency", "earnings_consistency(A.epspx)", f"CASE WHEN NOT (epspx IS NULL OR e12 IS NULL OR coalesce(abs({ratio('epspx', 'e12')}) > 6, false) OR coalesce(g > 0 AND g12 < 0, false) OR coalesce(g < 0 AND (g12 > 0 OR g12 IS NULL), false)) THEN list_avg(list_filter([{', '.join(terms)}], lambda v: v IS NOT NULL)) END", *growth)
    quarters = range(3, 25, 3)
    case("time__seasonal_surprise_zscore", "seasonal_surprise_zscore(C.prc)", fin("CASE WHEN sd > 1e-10 THEN s / sd END"),
         ("g", f"prc - {lag('prc', 12)}"), ("s", f"g - list_avg(list_filter([{', '.join(lag('g', k) for k in quarters)}], lambda v: v IS NOT NULL))"), ("sd", f"list_stddev_samp(list_filter([{', '.join(lag('s', k) for k in quarters)}], lambda v: v IS NOT NULL))"))
    case("time__hire_growth", "hire_growth(A.emp)", f"CASE WHEN compustat THEN CASE WHEN emp IS NULL OR e12 IS NULL THEN 0 ELSE {ratio('emp - e12', '0.5 * (emp + e12)')} END END", ("e12", lag("emp", 12)))
    case("time__rolling_trend_slope_scaled", "rolling_trend_slope_scaled(C.ret, window_months=24, min_obs=12)", f"{ratio('carried', 'nullif(mean, 0)')}",
         ("k", f"CASE WHEN ret IS NOT NULL THEN {so_far('count(ret)')} END"), ("slope", "CASE WHEN ret IS NOT NULL AND k >= 12 THEN regr_slope(ret, m) FILTER (WHERE ret IS NOT NULL) OVER (PARTITION BY e ORDER BY k NULLS FIRST RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) END"),
         ("carried", so_far("last_value(slope IGNORE NULLS)")), ("mean", f"CASE WHEN {frame('count(ret)', 23)} >= 12 THEN {frame('avg(ret)', 23)} END"))
    preferred = "coalesce(pstk, pstkrv, pstkl)"
    case("time__bmdec_signal", "bmdec_signal(A.ceq, A.txditc, A.seq, A.at, A.lt, A.pstk, A.pstkrv, A.pstkl, C.prc, C.shrout)", fin(ratio(f"coalesce(seq, ceq + {preferred}, at - lt) + coalesce(txditc, 0) - {preferred}", "CASE WHEN m % 12 + 1 >= 6 THEN d1 ELSE d2 END")),
         ("dec", "CASE WHEN m % 12 = 11 THEN abs(prc) * shrout END"), ("y", YEAR), *((f"d{k}", f"min(dec) OVER (PARTITION BY e ORDER BY y RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)") for k in (1, 2)))
    # Masks.
    case("mask__smt_only", "smt_only(C.prc)", "CASE WHEN strict THEN prc END")
    case("mask__smt_fill", "smt_fill(A.dlc, value=0)", "CASE WHEN strict THEN coalesce(dlc, 0) END")
    case("mask__span_fill", "span_fill(C.ret, value=0)", "CASE WHEN inside THEN coalesce(CASE WHEN strict THEN ret END, 0) END", _IN)
    case("mask__span_only", "span_only(A.at)", "CASE WHEN inside THEN at END", _IN)
    case("mask__crsp_only", "crsp_only(A.at)", "CASE WHEN listed THEN at END")
    case("mask__smt_gvkey_only", "smt_gvkey_only(C.prc)", "CASE WHEN linked THEN prc END")
    case("mask__compustat_rows_only", "compustat_rows_only(C.prc)", "CASE WHEN compustat THEN prc END")
    case("mask__compustat_span_fill", "compustat_span_fill(A.xrd, value=0)", f"CASE WHEN {span('compustat')} THEN coalesce(xrd, 0) END")
    case("mask__firm_age", "firm_age(C.prc)", "CASE WHEN strict AND age <> round_even(date_diff('day', DATE '1926-07-01', make_date(floor(m / 12)::INT, (m % 12 + 1)::INT, 1)) / 30.44, 0) + 1 THEN age END", ("age", so_far("sum(CASE WHEN strict THEN 1 ELSE 0 END)")))
    # Across entities.
    case("xs__size_filtered", "size_filtered(C.ret, C.mve_c, min_tercile=2)", "CASE WHEN NOT coalesce(b < 2, false) THEN ret END", *qcut_steps("b", "mve_c", 3))
    case("xs__size_filtered_quintile", "size_filtered(C.ret, C.mve_c, min_tercile=None, max_quintile=3, drop_missing_size=True)", "CASE WHEN NOT coalesce(b > 3, false) AND b IS NOT NULL THEN ret END", *qcut_steps("b", "mve_c", 5))
    case("xs__size_decile_filtered", "size_decile_filtered(C.ret, C.mve_c)", "CASE WHEN NOT coalesce(b = 1, false) THEN ret END", ("sz", "CASE WHEN compustat THEN mve_c END"), *qcut_steps("b", "sz", 10))
    case("xs__monthly_fastxtile_exclude", "monthly_fastxtile_exclude(C.ret, C.vol, n=5, max_excluded=2)", "CASE WHEN NOT coalesce(b <= 2, false) THEN ret END", *fastxtile_steps("b", "vol", 5))
    case("xs__industry_adjusted_mean", "industry_adjusted_mean(C.ret, C.sicCRSP, min_industry_obs=3)", "CASE WHEN count(x) OVER (PARTITION BY m, ind) >= 3 THEN x - avg(x) OVER (PARTITION BY m, ind) END", ("ind", _SIC2), ("x", f"CASE WHEN ind IS NOT NULL THEN {fin('ret')} END"))
    case("xs__industry_weighted_momentum", "industry_weighted_momentum(C.ret, C.mve_c, C.sicCRSP)", "CASE WHEN ind IS NOT NULL THEN sum(CASE WHEN ok THEN mom * mve_c END) OVER (PARTITION BY m, ind) / sum(CASE WHEN ok THEN mve_c END) OVER (PARTITION BY m, ind) END", ("mom", compound("ret", [1, 5])), ("ind", _SIC2), ("ok", "mom IS NOT NULL AND mve_c > 0 AND ind IS NOT NULL"))
    rank = "(rank() OVER (PARTITION BY m, ind, mve_c IS NULL ORDER BY mve_c) + (count(*) OVER (PARTITION BY m, ind, mve_c) - 1) / 2.0) / count(mve_c) OVER (PARTITION BY m, ind)"
    big = [("ind", "CAST(floor(sicCRSP / 250) AS INT)"), ("pr", f"CASE WHEN ind IS NOT NULL AND mve_c IS NOT NULL THEN {rank} END")]
    case("xs__industry_big_mean", "industry_big_mean(C.ret, C.mve_c, industry48(C.sicCRSP))", "CASE WHEN ind IS NOT NULL AND NOT coalesce(pr >= 0.7, false) THEN avg(CASE WHEN coalesce(pr >= 0.7, false) THEN ret END) OVER (PARTITION BY m, ind) END", *big)
    strict_big = [("sz", "CASE WHEN strict THEN mve_c END"), ("ind", "CASE WHEN strict THEN CAST(floor(sicCRSP / 250) AS INT) END"), ("pr", f"CASE WHEN ind IS NOT NULL AND sz IS NOT NULL THEN {rank.replace('mve_c', 'sz')} END")]
    case("xs__industry_big_return", "industry_big_return(C.ret, C.mve_c, industry48(C.sicCRSP))", "CASE WHEN ind IS NOT NULL AND NOT coalesce(pr >= 0.7, false) THEN avg(CASE WHEN coalesce(pr > 0.7, false) THEN ret END) OVER (PARTITION BY m, ind) END", *strict_big)
    case("xs__rolling_industry_herfindahl", "rolling_industry_herfindahl(A.sale, C.sicCRSP, C.shrcd, window_months=36, min_obs=12, min_year=1951)", f"CASE WHEN inside AND NOT (strict AND (coalesce(shrcd > 11, false) OR coalesce(ind LIKE '49%', false))) THEN mean END",
         _IN, ("ind", "CASE WHEN strict THEN substr(CAST(CAST(floor(sicCRSP) AS BIGINT) AS VARCHAR), 1, 4) END"), ("x", "CASE WHEN strict AND ind IS NOT NULL THEN sale END"), ("sh", ratio("x", "sum(x) OVER (PARTITION BY m, ind)")), ("h", "CASE WHEN ind IS NOT NULL THEN coalesce(sum(sh * sh) OVER (PARTITION BY m, ind), 0) END"), ("mean", f"CASE WHEN {frame('count(h)', 35)} >= 12 THEN {frame('avg(h)', 35)} END"))
    case("xs__weighted_lagged_rank_growth", "weighted_lagged_rank_growth(C.vol)", " + ".join(f"{6 - k} * {lag('rk', 12 * k)}" for k in range(1, 6)).join("()") + " / 15.0", ("g", f"CASE WHEN vol > 0 AND {lag('vol', 12)} > 0 THEN ln(vol) - ln({lag('vol', 12)}) END"), ("rk", "CASE WHEN g IS NOT NULL THEN row_number() OVER (PARTITION BY m ORDER BY g DESC NULLS LAST, e) END"))
    case("xs__firm_age_momentum", "firm_age_momentum(C.ret, C.prc)", "CASE WHEN keep AND b = 1 THEN mom END", ("age", f"CASE WHEN strict THEN {so_far('sum(CASE WHEN strict THEN 1 ELSE 0 END)')} END"), ("keep", "strict AND (prc IS NULL OR abs(prc) >= 5) AND coalesce(age >= 12, false)"), ("x", "CASE WHEN keep THEN coalesce(ret, 0) END"), ("mom", compound("x", [1, 5])), ("ag", "CASE WHEN keep THEN CAST(age AS DOUBLE) END"), *qcut_steps("b", "ag", 5))
    case("xs__momentum_reversal_signal", "momentum_reversal_signal(C.ret)", "CASE WHEN a = 5 AND b = 1 THEN 1 WHEN a = 1 AND b = 5 THEN 0 END", _R0, _IN, ("x", f"CASE WHEN inside THEN {compound('r', [1, 5])} END"), ("y", f"CASE WHEN inside THEN {compound('r', [13, 36])} END"), *qcut_steps("a", "x", 5), *qcut_steps("b", "y", 5))
    case("xs__momentum_volume_signal", "momentum_volume_signal(C.ret, C.vol)", "CASE WHEN b = 3 AND m - first >= 23 THEN a END", _R0, _IN, ("v1", "CASE WHEN strict AND vol >= 0 THEN vol END"), ("x", f"CASE WHEN inside THEN {compound('r', [1, 5])} END"), ("y", f"CASE WHEN inside AND {frame('count(v1)', 5)} >= 5 THEN {frame('avg(v1)', 5)} END"), ("first", "min(CASE WHEN strict THEN m END) OVER (PARTITION BY e)"), *qcut_steps("a", "x", 10), *qcut_steps("b", "y", 3))
    case("xs__share_volume_signal", "share_volume_signal(smt_only(C.vol), smt_only(C.shrout))", "CASE WHEN strict AND (NOT (c = 1 OR coalesce(c1 = 1, false) OR coalesce(c2 = 1, false)) OR nth < 2) THEN CASE WHEN t IS NULL OR t > 10 THEN 1 WHEN t < 5 THEN 0 END END",
         ("v", "CASE WHEN strict THEN vol END"), ("sh", "CASE WHEN strict THEN shrout END"), ("t", f"(v + {lag('v', 1)} + {lag('v', 2)}) / (3 * sh) * 100"), ("c", f"CASE WHEN sh <> {lag('sh', 1)} THEN 1 ELSE 0 END"), ("c1", lag("c", 1)), ("c2", lag("c", 2)), ("nth", so_far("sum(CASE WHEN strict THEN 1 ELSE 0 END)") + " - 1"))
    case("xs__accruals_bm_signal", "accruals_bm_signal(C.vol, C.ret, A.ceq)", "CASE WHEN ceq >= 0 THEN CASE WHEN a = 5 AND b = 1 THEN 1 WHEN a = 1 AND b = 5 THEN 0 END END", *fastxtile_steps("a", "vol", 5), *fastxtile_steps("b", "ret", 5))
    nearest = lambda q: f"(SELECT list_sort(list(ret) FILTER (WHERE ret IS NOT NULL))[CAST(floor({q} * (count(ret) - 1) + 0.5) AS INT) + 1] FROM p)"
    case("xs__trim_global", "trim_global(C.ret, lower_q=0.01, upper_q=0.99)", f"CASE WHEN ret BETWEEN {nearest(0.01)} AND {nearest(0.99)} THEN ret END")
    case("xs__trim_by_month", "trim_by_month(C.ret, lower_q=0.05, upper_q=0.95)", "CASE WHEN ret BETWEEN quantile_cont(ret, 0.05) OVER (PARTITION BY m) AND quantile_cont(ret, 0.95) OVER (PARTITION BY m) THEN ret END")
    case("xs__cs_rank", "cs_rank(C.ret)", "CASE WHEN ret IS NOT NULL THEN 2 * (rank() OVER (PARTITION BY m, ret IS NULL ORDER BY ret) + (count(*) OVER (PARTITION BY m, ret) - 1) / 2.0) / (count(ret) OVER (PARTITION BY m) + 1) - 1 END")
    sample = "strict AND compustat AND coalesce({s} < 6000 OR {s} >= 7000, false) AND NOT coalesce(ceq <= 0, false)".replace("{s}", number("sic"))
    me = [("me", "CASE WHEN strict AND compustat THEN mve_permco END"), ("me6", lag("me", 6))]
    case("xs__netpayout_yield_signal", "netpayout_yield_signal(A.dvc, A.prstkc, A.sstk, C.mve_permco, A.sic, A.ceq)", f"CASE WHEN ok AND {so_far('sum(CASE WHEN ok THEN 1 ELSE 0 END)')} >= 24 THEN v END", *me, ("v", ratio("dvc + prstkc - sstk", "me6")), ("ok", f"{sample} AND NOT coalesce(v = 0 AND dvc = 0 AND prstkc = 0 AND sstk = 0, false)"))
    case("xs__payout_yield_signal", "payout_yield_signal(A.dvc, A.prstkc, A.pstkrv, C.mve_permco, A.sic, A.ceq)", f"CASE WHEN ok AND v > 0 AND {so_far('sum(CASE WHEN ok THEN 1 ELSE 0 END)')} >= 24 THEN v END", *me, ("v", ratio("dvc + prstkc + pstkrv", "me6")), ("ok", sample))
    metrics = ["ib", "cash", "d1", "cash - ib", "d2", "d3", "d4", "d5", "d6"]
    inf = "CAST('inf' AS DOUBLE)"
    edge = lambda x: f"(CASE WHEN abs({x}) < {inf} THEN {x} ELSE {inf} END)"
    u = [(f"u_{c}", f"CASE WHEN strict AND compustat AND listed THEN {c} END") for c in ("fopt", "oancf", "ib", "at", "dltt", "act", "lct", "txt", "xint", "sale", "ceq", "mve_permco", "shrout")]
    change = lambda a, b: (f"({ratio('u_' + a, 'u_' + b)})")
    ratios = [("q1", change("ib", "at")), ("q2", change("dltt", "at")), ("q3", change("act", "lct")), ("q5", change("sale", "at")), ("ebit", "u_ib + u_txt + u_xint"), ("sale12", lag("u_sale", 12)), ("cash", "coalesce(u_fopt, u_oancf)")]
    ratios += [("d1", f"q1 - {lag('q1', 12)}"), ("d2", f"q2 - {lag('q2', 12)}"), ("d3", f"q3 - {lag('q3', 12)}"), ("d4", f"({ratio('ebit', 'u_sale')}) - ({ratio('ebit', 'sale12')})"), ("d5", f"q5 - {lag('q5', 12)}"), ("d6", f"{lag('u_shrout', 12)} - u_shrout"), ("bm0", ratio("CASE WHEN u_ceq > 0 THEN u_ceq END", "u_mve_permco")), ("bm", fin(log("bm0"))), *qcut_steps("b", "bm", 5)]
    del metrics
    points = [f"CASE WHEN {edge('u_ib')} > 0 THEN 1 ELSE 0 END", f"CASE WHEN {edge('cash')} > 0 THEN 1 ELSE 0 END", f"CASE WHEN {edge('(cash - u_ib)')} > 0 THEN 1 ELSE 0 END", f"CASE WHEN {edge('d2')} < 0 THEN 1 ELSE 0 END", f"CASE WHEN {edge('d6')} >= 0 THEN 1 ELSE 0 END"] + [f"CASE WHEN {edge(d)} > 0 THEN 1 ELSE 0 END" for d in ("d1", "d3", "d4", "d5")]
    case("xs__piotroski_score", "piotroski_score(A.fopt, A.oancf, A.ib, A.at, A.dltt, A.act, A.lct, A.txt, A.xint, A.sale, A.ceq, C.mve_permco, C.shrout)", "CASE WHEN b = 5 AND " + " AND ".join(f"{c} IS NOT NULL" for c in ("cash", "u_ib", "u_at", "u_dltt", "u_act", "ebit", "u_sale", "u_shrout")) + " THEN " + " + ".join(points) + " END", *u, *ratios)


def flagship() -> str:
    """SQL of the factors of the flagship query, stacked."""
    parts = {
        "AM": steps(0, ratio("at", "mve_permco")),
        "AssetGrowth": steps(12, ratio("at - a12", "nullif(a12, 0)"), ("a12", lag("at", 12))),
        "Mom12m": steps(11, f"CASE WHEN inside THEN {compound('r', [1, 11])} END", _R0, _IN),
        "Size": steps(0, f"CASE WHEN strict THEN {log('mve_c')} END"),
        "STreversal": steps(0, "CASE WHEN strict THEN coalesce(ret, 0) END"),
    }
    return " UNION ALL ".join(f"SELECT e, m, '{name}' AS factor, value FROM ({sql}) q_{name}" for name, sql in parts.items())


_fill()


def tree(name: str) -> Expr:
    return parse(CASES[name][0], shared(), DATASETS)
