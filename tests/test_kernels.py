"""Operators that SQL cannot say (solutions of least norm, collinear regressors) against numpy, row by row.

Tables come from DuckDB, so nothing but the rules is shared with the library.
"""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cadenza import queries
from cadenza.oracles import kernels
from cadenza.sources.standins import duckdb_with

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def table(db, name):
    return db.execute(f"WITH {duckdb_with(name)} SELECT * FROM {name}").df()


def query(spark, name):
    return {(r["e"], r["m"]): r["value"] for r in queries.queries()[name](spark, SF_DIR).collect()}


def on_spine(db, cells):
    stock = table(db, "stock_month")
    ends = stock.groupby("e")["m"].agg(["min", "max"])
    return {(e, m): v for (e, m), v in cells.items() if e in ends.index and ends.at[e, "min"] <= m <= ends.at[e, "max"] and not np.isnan(v)}


def same(got, want, tolerance=2e-6):
    assert set(got) == set(want)
    assert want and all(got[k] == pytest.approx(v, rel=1e-6, abs=tolerance) for k, v in want.items())


def least_squares(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def nearest(values, q):
    arr = np.sort(np.asarray(values, float))
    return arr[int(np.floor(q * (len(arr) - 1) + 0.5))] if len(arr) else np.nan


def test_predicted_forecast_error(spark, db):
    june = db.execute(f"WITH {duckdb_with(*kernels.VALUATION_TABLES)}, {kernels.valuation(24)} SELECT * FROM june").df().set_index(["e", "m"]).sort_index().astype(float)
    traits = ["sg", "bm", "optimism", "ltg"]
    before = june.copy()
    before.index = pd.MultiIndex.from_tuples([(e, m + 12) for e, m in june.index], names=["e", "m"])
    ranks = june[traits].groupby("m").rank(pct=True)
    lagged = ranks.copy()
    lagged.index = before.index
    error = before["froe1"].reindex(june.index) - june["roe"]
    cells = {}
    for m, own in june.groupby("m"):
        y = error[own.index]
        y = y.where((y >= nearest(y.dropna(), 0.01)) & (y <= nearest(y.dropna(), 0.99)))
        fit = pd.concat([y.rename("y"), lagged.reindex(own.index)], axis=1).dropna()
        beta = least_squares(fit[traits].to_numpy(), fit["y"].to_numpy()) if len(fit) else np.zeros(5)
        for key, row in ranks.loc[own.index].dropna().iterrows():
            for k in range(12):
                cells[key[0], m + k] = beta[0] + row.to_numpy() @ beta[1:]
    same(query(spark, "join__predicted_forecast_error"), on_spine(db, cells))


def test_abnormal_accruals(spark, db):
    d = table(db, "statement_year").sort_values(["firm", "fyear"])
    old = d.groupby("firm")[["act", "che", "lct", "dlc", "at", "sale"]].shift(1).where((d["fyear"] - d.groupby("firm")["fyear"].shift(1) == 1), np.nan)
    cash = d["oancf"].fillna(d["fopt"] - (d["act"] - old["act"]) + (d["che"] - old["che"]) + (d["lct"] - old["lct"]) - (d["dlc"] - old["dlc"]))
    tops = {"y": d["ib"] - cash, "x1": pd.Series(1.0, d.index), "x2": d["sale"] - old["sale"], "x3": d["ppegt"]}
    names = list(tops)
    member = {n: tops[n].notna() & old["at"].notna() for n in names}  # 0/0 is a member, above all others
    with np.errstate(all="ignore"):
        for n in names:
            d[n] = tops[n].to_numpy(float) / old["at"].to_numpy(float)
    d["ind"] = np.floor(d["sic"].astype(float) / 100)
    gap = d.groupby("firm")["fyear"].shift(-1) > d["fyear"] + 1
    bounds, betas = {}, {}
    for year, own in d.groupby("fyear"):
        for n in names:
            pool = list(own.loc[member[n][own.index], n])
            if n == "x1":
                pool += [1 / a for a in own.loc[gap[own.index] & own["at"].notna(), "at"]]
            bounds[year, n] = (nearest(pool, 0.001), nearest(pool, 0.999))
    inside = lambda rows, year: rows[np.logical_and.reduce([~((rows[n] < bounds[year, n][0]) | (rows[n] > bounds[year, n][1])) for n in names])]
    for key, own in d.dropna(subset=[*names, "ind"]).groupby(["fyear", "ind"]):
        fit = inside(own, key[0])
        if len(fit) >= 6 and np.isfinite(fit[names].to_numpy()).all():
            betas[key] = least_squares(fit[names[1:]].to_numpy(), fit["y"].to_numpy())
    value = {}
    for key, own in d.dropna(subset=[*names, "ind"]).groupby(["fyear", "ind"]):
        if (beta := betas.get((key[0] - 1, key[1]))) is not None:
            for _, r in inside(own, key[0] - 1).iterrows():
                value[r["e"], key[0]] = (r["m"], r["y"] - beta[0] - r[names[1:]].to_numpy(float) @ beta[1:])
    cells = {}
    for (e, _), (m, v) in sorted(value.items()):
        cells |= {(e, m + k): v for k in range(12) if np.isfinite(v)}
    same(query(spark, "join__abnormal_accruals_signal"), on_spine(db, cells))


def test_frontier(spark, db):
    stock = table(db, "stock_month")
    stock = stock[stock["shrcd"].isin([10, 11, 12]) & stock["exchcd"].isin([1, 2, 3])]
    d = stock[["e", "m", "mve_permco", "sicCRSP"]].merge(table(db, "statement_month").drop_duplicates(["e", "m"]), on=["e", "m"])
    d = d[(d["ceq"] > 0) & (d["mve_permco"] > 0)]
    over = lambda a, b: d[a] / d[b].where(d[b] != 0)
    d["xad"] = d["xad"].fillna(0)
    d["y"], d["x1"] = np.log(d["mve_permco"]), np.log(d["ceq"])
    for k, (a, b) in enumerate([("dltt", "at"), ("capx", "sale"), ("xrd", "sale"), ("xad", "sale"), ("ppent", "at"), ("ebitda", "at")], 2):
        d[f"x{k}"] = over(a, b)
    names = [f"x{k}" for k in range(1, 8)]
    d["ind"] = np.floor(d["sicCRSP"] / 250)
    d = d.dropna(subset=["y", *names, "ind"])
    cells = {}
    for m in sorted(d["m"].unique())[::7]:  # every seventh month is compared
        train = d[(d["m"] <= m) & (d["m"] > m - 60)]
        kinds = sorted(train["ind"].unique())
        design = lambda rows: np.column_stack([rows[names].to_numpy(), *(rows["ind"].to_numpy() == k for k in kinds)])
        beta = least_squares(design(train), train["y"].to_numpy())
        now = d[d["m"] == m]
        for e, fit, y in zip(now["e"], beta[0] + design(now) @ beta[1:], now["y"], strict=True):
            cells[e, m] = fit - y
    months = {m for _, m in cells}
    same({k: v for k, v in query(spark, "regress__frontier_signal").items() if k[1] in months}, on_spine(db, cells), 1e-5)


def test_trend_factor(spark, db):
    windows = [3, 5, 10, 20, 50]
    day = table(db, "stock_day").sort_values(["e", "d"])
    day["m"] = pd.to_datetime(day["d"]).dt.year * 12 + pd.to_datetime(day["d"]).dt.month - 1
    day["p"] = day["prc"].abs() / day["cfacpr"]
    for w in windows:
        day[f"a{w}"] = day.groupby("e")["p"].transform(lambda x, w=w: x.rolling(w, min_periods=1).mean()) / day["p"]
    names = [f"a{w}" for w in windows]
    last = day.groupby(["e", "m"]).tail(1)[["e", "m", *names]]
    u = table(db, "universe")
    edge = {}
    for m, own in u[u["exchcd"] == 1].groupby("m"):
        v = np.sort(own["mve"].dropna().to_numpy())
        if len(v):
            p = 0.1 * len(v)
            k = int(np.floor(p + 1e-12))
            edge[m] = (v[k - 1] + v[k]) / 2 if abs(p - k) < 1e-12 and 1 <= k < len(v) else v[min(k, len(v) - 1)]
    inf = np.inf
    passed = u["exchcd"].isin([1, 2, 3]) & u["shrcd"].isin([10, 11]) & (u["prc"].abs().fillna(inf) >= 5) & (u["mve"].fillna(inf) >= u["m"].map(edge).fillna(inf))
    panel = u.loc[passed, ["e", "m", "ret"]].merge(last, on=["e", "m"])
    following = panel[["e", "m", "ret"]].assign(m=panel["m"] - 1).rename(columns={"ret": "next"})
    panel = panel.merge(following, on=["e", "m"], how="left")
    betas = []
    for m, own in panel.groupby("m"):
        rows = own[["next", *names]].dropna()
        b = np.full(len(names), np.nan)
        if len(rows):
            b[:] = 0
            x = rows[names].to_numpy()
            kept = []
            rest = x / np.linalg.norm(x, axis=0)
            use = [k for k in range(len(names)) if np.ptp(x[:, k]) > 0]
            while len(kept) < min(len(use), len(rows)):
                left = [k for k in use if k not in kept]
                k = max(left, key=lambda j: np.linalg.norm(rest[:, j]))
                if np.linalg.norm(rest[:, k]) <= 1e-6:
                    break
                kept.append(k)
                q = rest[:, k] / np.linalg.norm(rest[:, k])
                rest = rest - np.outer(q, q @ rest)
            if kept:
                b[sorted(kept)] = least_squares(x[:, sorted(kept)], rows["next"].to_numpy())[1:]
        betas.append((m, b))
    expected = {m: np.nanmean([b for _, b in betas[max(0, k - 12) : k]], axis=0) for k, (m, _) in enumerate(betas) if k and not all(np.isnan(b).any() for _, b in betas[max(0, k - 12) : k])}
    cells = {(e, m): float(np.dot(expected[m], a)) for e, m, *a in panel[["e", "m", *names]].itertuples(index=False) if m in expected and not np.isnan(a).any()}
    same(query(spark, "regress__trendfactor_signal"), on_spine(db, cells), 1e-5)


def test_intangible_residual(spark, db):
    base = f"WITH {duckdb_with('stock_month', 'statement_month')}, f AS (SELECT e, m, max(prc) AS prc, max(ret) AS ret, bool_or(shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3)) AS strict FROM stock_month GROUP BY e, m) SELECT f.*, f.strict AND s.e IS NOT NULL AS u FROM f LEFT JOIN (SELECT DISTINCT e, m FROM statement_month) s USING (e, m)"
    d = db.execute(base).df()
    rows = {}
    for e, own in d.groupby("e"):
        own = own.set_index("m").reindex(range(own["m"].min(), own["m"].max() + 1))
        u = own["u"].astype("boolean").fillna(False).astype(bool)
        cum = np.exp(np.where(u, np.log1p(own["ret"].astype(float).fillna(0)), 0).cumsum())
        for k in range(60, len(own)):
            if u.iloc[k] and u.iloc[k - 60]:
                rows[e, own.index[k]] = (cum[k] / cum[k - 60] - 1, own["prc"].iloc[k - 60], own["prc"].iloc[k])
    t = pd.DataFrame([(e, m, *v) for (e, m), v in rows.items()], columns=["e", "m", "y", "x1", "now"])
    q = t.groupby("m")["y"].transform
    t.loc[(t["y"] < q(lambda v: v.quantile(0.01))) | (t["y"] > q(lambda v: v.quantile(0.99))), "y"] = np.nan
    t["x2"] = t["now"] - t["x1"] + t["y"]
    cells = {}
    for m, own in t.dropna().groupby("m"):
        if len(own) >= 3:
            b = least_squares(own[["x1", "x2"]].to_numpy(), own["y"].to_numpy())
            cells |= {(e, m): v for e, v in zip(own["e"], own["y"] - b[0] - own[["x1", "x2"]].to_numpy() @ b[1:], strict=True)}
    same(query(spark, "regress__intangible_residual"), on_spine(db, cells), 1e-5)
