"""The whole catalogue as queries, and SQL of the factors whose operators a short table below can say in SQL.

The table knows nothing of the compiler: a factor becomes layers of a select, one column for each sub-expression.
"""

from __future__ import annotations

from collections.abc import Callable

from cadenza.oracles.panel import ROUNDED, base, compound, fin, frame, lag, log, number, ratio, so_far, span, sql_names
from cadenza.plans.catalog import FORMULAS, factor
from cadenza.plans.expr import Expr
from cadenza.sources.standins import ANNUAL_ITEMS

Steps = list[tuple[str, str]]
_LEAVES = ("stock_month", "statement_month")


def _if(condition: str, x: str) -> str:
    return f"CASE WHEN {condition} THEN {x} END"


def _unless(condition: str, x: str) -> str:
    return f"CASE WHEN NOT coalesce({condition}, false) THEN {x} END"


def _tight(lags: list[int]) -> bool:
    return sorted(lags) == list(range(min(lags), max(lags) + 1))


def _held(c: str, x: str, code: str) -> Steps:
    return [(f"{c}_l", lag(x, 6)), (f"{c}_s", _if(f"{code} = m - 6", f"{c}_l")), (c, so_far(f"last_value({c}_s IGNORE NULLS)"))]


#: Operator -> SQL of its value, from the names of its arguments and its parameters.
SIMPLE: dict[str, Callable[..., str]] = {
    "add": lambda *a: " + ".join(a),
    "sub": lambda a, b: f"{a} - {b}",
    "mul": lambda *a: " * ".join(a),
    "div": lambda a, b: ratio(a, b),
    "log": lambda x: log(x),
    "pow": lambda x, power: f"power({x}, {power})",
    "abs": lambda x: f"abs({x})",
    "max": lambda a, b: _if(f"{a} IS NOT NULL AND {b} IS NOT NULL", f"greatest({a}, {b})"),
    "fillna": lambda x, other=None, value=None: f"coalesce({x}, {other or value})",
    "coalesce": lambda *a: f"coalesce({', '.join(a)})",
    "positive_only": lambda x: _if(f"{x} > 0", x),
    "negative_to_null": lambda x: _if(f"{x} >= 0", x),
    "zero_to_null": lambda x: f"nullif({x}, 0)",
    "nonzero": lambda x: f"nullif({x}, 0)",
    "positive_indicator": lambda x: f"CASE WHEN {x} > 0 THEN 1 WHEN {x} <= 0 THEN 0 END",
    "abs_cap_to_null": lambda x, max_abs: _if(f"abs({x}) <= {max_abs}", x),
    "threshold_min": lambda x, y, min_value: _if(f"{y} >= {min_value}", x),
    "year_filtered": lambda x, min_year=0, max_year=9999: _if(f"floor(m / 12) BETWEEN {min_year} AND {max_year}", x),
    "nonfinancial_only": lambda x, sic: _if(f"{number(sic)} < 6000 OR {number(sic)} >= 7000", x),
    "manufacturing_only": lambda x, sic: _if(f"{number(sic)} BETWEEN 2000 AND 3999", x),
    "financial_excluded": lambda x, sic: _unless(f"{number(sic)} >= 6000 AND {number(sic)} < 7000", x),
    "shrcd_le11": lambda x, code: _unless(f"{code} > 11", x),
    "convertible_debt_indicator": lambda a, b: _if(f"{a} IS NOT NULL OR {b} IS NOT NULL", f"CASE WHEN coalesce({a} <> 0, false) OR coalesce({b} <> 0, false) THEN 1 ELSE 0 END"),
    "smt_only": lambda x: _if("strict", x),
    "smt_fill": lambda x, value: _if("strict", f"coalesce({x}, {value})"),
    "span_fill": lambda x, value: _if(span("strict"), f"coalesce({_if('strict', x)}, {value})"),
    "span_only": lambda x: _if(span("strict"), x),
    "crsp_only": lambda x: _if("listed", x),
    "smt_gvkey_only": lambda x: _if("linked", x),
    "compustat_rows_only": lambda x: _if("compustat", x),
    "compustat_span_fill": lambda x, value: _if(span("compustat"), f"coalesce({x}, {value})"),
    "lag": lambda x, n: lag(x, n),
    "time_lagged_value": lambda x, months: lag(x, months),
    "delta": lambda x, n: f"{x} - {lag(x, n)}",
    "ffill": lambda x: so_far(f"last_value({x} IGNORE NULLS)"),
    "rolling_mean": lambda x, window_months, min_obs: _if(f"{frame(f'count({x})', window_months - 1)} >= {min_obs}", frame(f"avg({x})", window_months - 1)),
    "rolling_std": lambda x, window_months, min_obs: _if(f"{frame(f'count({x})', window_months - 1)} >= {min_obs}", frame(f"stddev_samp({x})", window_months - 1)),
    "mean_of_lags": lambda x, lags: f"list_avg(list_filter([{', '.join(lag(x, k) for k in lags)}], lambda v: v IS NOT NULL))",
}

#: Operators that need several layers: column name, arguments and parameters -> columns, the last one their value.
LAYERED: dict[str, Callable[..., Steps]] = {
    "compound_return": lambda c, x, lags, fill_missing=None: [(f"{c}_x", x if fill_missing is None else f"coalesce({x}, {fill_missing})"), (c, compound(f"{c}_x", lags))],
    "require_any_lag": lambda c, x, y, lags: [(f"{c}_y", _if("strict", y)), (c, _if(f"{frame(f'count({c}_y)', max(lags), min(lags))} > 0", x))],
    "bm_defined_gate": lambda c, x, ceq, me: [(f"{c}_q", ratio(ceq, me)), (c, _if(f"({log(f'{c}_q')}) IS NOT NULL", x))],
    "market_equity_matched_to_datadate": lambda c, x, code, lag_months: _held(c, x, code),
    "exchange_switch_indicator": lambda c, x, lookback_months: [(f"{c}_a", frame(f"max(CASE WHEN {x} IN (2, 3) THEN 1 ELSE 0 END)", 12, 1)), (f"{c}_b", frame(f"max(CASE WHEN {x} = 3 THEN 1 ELSE 0 END)", 12, 1)), (c, f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN ({x} = 1 AND coalesce({c}_a, 0) = 1) OR ({x} = 2 AND coalesce({c}_b, 0) = 1) THEN 1 ELSE 0 END END")],
    "enterprise_multiple": lambda c, me, dltt, dlc, dc, che, oibdp, ceq: [(c, _unless(f"{ceq} < 0 OR {oibdp} < 0", ratio(f"({me} + {dltt} + {dlc} + {dc} - {che})", oibdp)))],
    "total_accruals_signal": lambda c, *a: [(f"{c}_l", lag(a[11], 12)), (f"{c}_q", ratio(f"({a[13]} - ({a[14]} + {a[15]} + {a[16]}) + (coalesce({a[5]}, 0) - coalesce({a[6]}, 0) - coalesce({a[7]}, 0)))", f"{c}_l")), (c, fin(f"{c}_q"))],
    "hire_growth": lambda c, x: [(f"{c}_l", lag(x, 12)), (c, _if("compustat", f"CASE WHEN {x} IS NULL OR {c}_l IS NULL THEN 0 ELSE {ratio(f'({x} - {c}_l)', f'(0.5 * ({x} + {c}_l))')} END"))],
    "investment_to_sales_scaled": lambda c, a, b, window_months, min_obs: [(f"{c}_q", ratio(a, b)), (f"{c}_m", _if(f"{frame(f'count({c}_q)', window_months - 1)} >= {min_obs}", frame(f"avg({c}_q)", window_months - 1))), (c, _if(f"{b} >= 10", ratio(f"{c}_q", f"{c}_m")))],
}


def expressible(tree: Expr) -> bool:
    for x in tree.nodes().values():
        p = dict(x.params)
        if x.kind == "var" and (x.name.split(".")[0] not in _LEAVES or p):
            return False
        if x.kind == "op" and x.name not in SIMPLE and x.name not in LAYERED:
            return False
        if x.name in ("compound_return", "require_any_lag") and not _tight(p["lags"]):
            return False
    return True


def sql(trees: dict[str, Expr]) -> str:
    """(e, m, factor, value) of these factors."""
    nodes: dict[str, Expr] = {}
    for tree in trees.values():
        nodes |= tree.nodes()
    name: dict[str, str] = {}
    level: dict[str, int] = {}
    layers: list[Steps] = []

    def put(at: int, column: str, expr: str) -> None:
        while len(layers) <= at:
            layers.append([])
        layers[at].append((column, expr))

    for k, (key, x) in enumerate(nodes.items()):
        level[key] = 0
        if x.kind == "var":
            name[key] = x.name.split(".")[1]
            continue
        if x.kind == "const":
            name[key] = f"CAST({x.value!r} AS DOUBLE)"
            continue
        c, args, p = f"n{k}", [name[a.key] for a in x.args], dict(x.params)
        steps = LAYERED[x.name](c, *args, **p) if x.name in LAYERED else [(c, SIMPLE[x.name](*args, **p))]
        at = max((level[a.key] for a in x.args), default=0)
        for column, expr in steps:
            put(at, column, expr if x.name == "coalesce" else f"nullif(CAST({expr} AS DOUBLE), CAST('nan' AS DOUBLE))")
            at += 1
        name[key], level[key] = c, at
    out, last = base(max(t.reach for t in trees.values()), ANNUAL_ITEMS), "p"
    for k, layer in enumerate(layers):
        out += f",\ny{k} AS MATERIALIZED (SELECT *, " + ", ".join(f"{expr} AS {column}" for column, expr in layer) + f" FROM {last})"
        last = f"y{k}"
    parts = " UNION ALL ".join(f"SELECT e, m, '{n}' AS factor, CAST({name[t.key]} AS DOUBLE) AS v FROM {last}" for n, t in trees.items())
    return sql_names(f"{out},\nz AS ({parts})\nSELECT e, m, factor, {ROUNDED} AS value FROM z WHERE v IS NOT NULL AND NOT isnan(v)")


#: Factors that are evaluated together: at most so many.
SIZE = 14


def _groups() -> dict[str, list[str]]:
    said = [n for n in FORMULAS if expressible(factor(n))]
    rest = [n for n in FORMULAS if n not in set(said)]
    cut = lambda label, names: {f"catalogue__{label}_{k // SIZE + 1}": names[k : k + SIZE] for k in range(0, len(names), SIZE)}
    return cut("cells", said) | cut("signals", rest)


GROUPS = _groups()
SQL = {label: sql({n: factor(n) for n in names}) for label, names in GROUPS.items() if label.startswith("catalogue__cells")}
