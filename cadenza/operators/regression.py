"""Least squares over groups, months and rolling windows.

Several regressors are solved from cross-moments: sums of products are ordinary aggregates (partial, or windowed), and
only the small moment matrices of groups that have been added up reach Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from cadenza.plans.stage import Stage
from cadenza.sources.sinks import written


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moment_columns(y: Column, xs: list[Column], over: WindowSpec | None = None) -> list[Column]:
    """Sums of products of (1, xs, y), which must be present together, as columns m_i_j."""
    terms = [F.lit(1.0), *xs, y]
    present = y.isNotNull()
    for x in xs:
        present = present & x.isNotNull()
    out = []
    for i, j in _pairs(len(terms)):
        s = F.sum(F.when(present, terms[i] * terms[j]))
        out.append((s.over(over) if over is not None else s).alias(f"m_{i}_{j}"))
    return out


def unfolded(moments: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from rows of flat upper triangles."""
    full = np.zeros((len(moments), size, size))
    for n, (i, j) in enumerate(_pairs(size)):
        full[:, i, j] = full[:, j, i] = moments[:, n]
    return full


#: Matrices that are solved in one call.
BATCH = 20_000


def solve_moments(moments: np.ndarray, k: int, least: int, least_norm: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (constant first), residual sum of squares and count for rows of flat upper moment triangles.

    Regressors are centred and scaled, and all groups solved together.  Groups of fewer than ``least`` rows, or with
    infinite values, have missing coefficients; so have rank-deficient ones, unless ``least_norm`` asks for the solution
    of least norm (zeros for a group without rows).
    """
    coef, rss = np.full((len(moments), k + 1), np.nan), np.full(len(moments), np.nan)
    count = np.nan_to_num(moments[:, 0].astype(float))
    for at in range(0, len(moments), BATCH):
        part = slice(at, at + BATCH)
        coef[part], rss[part] = _solved(unfolded(moments[part], k + 2), k, least, least_norm)
    return coef, rss, count


def _solved(full: np.ndarray, k: int, least: int, least_norm: bool) -> tuple[np.ndarray, np.ndarray]:
    coef, rss = np.full((len(full), k + 1), np.nan), np.full(len(full), np.nan)
    full[np.isnan(full[:, 0, 0])] = 0  # no row at all
    count = full[:, 0, 0]
    with np.errstate(all="ignore"):
        mean = full[:, 0, 1:] / count[:, None]
        centred = full[:, 1:, 1:] - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        scale = np.sqrt(np.maximum(np.einsum("rii->ri", centred), 0))[:, :k]
        flat = (scale <= 1e-12 * np.sqrt(count)[:, None] * np.maximum(1e-300, np.abs(mean[:, :k]))).any(axis=1)
    good = np.flatnonzero((count >= max(least, k + 1)) & np.isfinite(centred).all(axis=(1, 2)) & ~flat)
    if len(good):
        sx, c = scale[good], centred[good]
        a, b = c[:, :k, :k] / (sx[:, :, None] * sx[:, None, :]), c[:, :k, k] / sx
        values, vectors = np.linalg.eigh(a)
        sound = values[:, 0] * 1e12 > values[:, -1]
        good, sx, c, values, vectors, b = (x[sound] for x in (good, sx, c, values, vectors, b))
        slopes = np.einsum("rij,rj->ri", vectors, np.einsum("rji,rj->ri", vectors, b) / values) / sx
        coef[good, 0] = mean[good, k] - np.einsum("ri,ri->r", slopes, mean[good, :k])
        coef[good, 1:] = slopes
        rss[good] = np.maximum(0.0, c[:, k, k] - np.einsum("ri,ri->r", slopes, c[:, :k, k]))
    if least_norm:
        rest = np.flatnonzero(np.isnan(coef[:, 0]) & (count >= least) & np.isfinite(full).all(axis=(1, 2)))
        for r in rest:  # few: groups whose rows do not suffice
            coef[r] = np.linalg.pinv(full[r, : k + 1, : k + 1], rcond=1e-12, hermitian=True) @ full[r, : k + 1, k + 1]
            rss[r] = max(0.0, full[r, k + 1, k + 1] - coef[r] @ full[r, : k + 1, k + 1])
    return coef, rss


def with_coefficients(df: DataFrame, k: int, least: int, least_norm: bool = False) -> DataFrame:
    """Replace moment columns by coefficients (b0 the constant, b1, ...), rss and nobs."""
    moments = [f"m_{i}_{j}" for i, j in _pairs(k + 2)]
    others = [c for c in df.columns if c not in moments]
    made = [*(f"b{i}" for i in range(k + 1)), "rss", "nobs"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), *(f"{c} double" for c in made)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            coef, rss, count = solve_moments(part[moments].to_numpy(float), k, least, least_norm)
            out = part[others].copy()
            for i in range(k + 1):
                out[f"b{i}"] = coef[:, i]
            out["rss"], out["nobs"] = rss, count
            yield out

    solved = df.mapInPandas(run, schema)
    return solved.select(*others, *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in made))


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str], least: int = 1, least_norm: bool = False) -> DataFrame:
    """One row for each group: keys, b0.., rss, nobs."""
    moments = df.groupBy(*keys).agg(*moment_columns(F.col(y), [F.col(x) for x in xs]))
    return with_coefficients(moments, len(xs), least, least_norm)


def residuals_by_month(s: Stage, y: Column, xs: list[Column]) -> Column:
    """Residuals of one regression in each month, over rows where everything is present.

    These rows are written once.  Fits, residuals and the stage would else each hold the stage's plan, so that it grew
    threefold with each such operator and filled the driver.
    """
    names = [f"x{i}" for i in range(len(xs))]
    rows = written(s.rows(y, *xs, names=["y", *names]).dropna(subset=["y", *names]), "residual-rows")
    fits = grouped_ols(rows, ["m"], "y", names, len(xs) + 1)
    joined = rows.join(fits, "m")
    fitted = F.col("b0")
    for i, n in enumerate(names, 1):
        fitted = fitted + F.col(f"b{i}") * F.col(n)
    return s.attach(joined.select("e", "m", (F.col("y") - fitted).alias("value")))


def rolling_coefficients(rows: DataFrame, y: str, xs: list[str], window: int, least: int, order: str = "m") -> DataFrame:
    """Coefficients over each entity's trailing ``window`` rows (e, order, y, xs all present): columns of rows and b0.."""
    from pyspark.sql import Window as W

    frame = W.partitionBy("e").orderBy(order).rowsBetween(-(window - 1), 0)
    moments = rows.select("*", *moment_columns(F.col(y), [F.col(x) for x in xs], frame))
    return with_coefficients(moments, len(xs), least)
