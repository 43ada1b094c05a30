"""Comparison of panels and vintages: cell by cell, table by table, factor by factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Full outer join of two panels: keys, a, b; missing rows and missing values are alike."""
    a = left.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("a"))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("b"))
    return a.join(b, keys, "full_outer")


def differs(a: Column, b: Column, atol: float = 0.0, rtol: float = 0.0) -> Column:
    """Whether two present values differ: infinities must be equal, finite values within atol + rtol |b|."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return F.when(infinite, a != b).otherwise(F.abs(a - b) > atol + rtol * F.abs(b))


def diff_panels(left: DataFrame, right: DataFrame, keys: list[str] | None = None, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """One row: cells in both, in one only, differing ones, and the greatest difference."""
    rows = compared(left, right, keys or ["e", "m"])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    bad = both & differs(F.col("a"), F.col("b"), atol, rtol)
    n = lambda c: F.count(F.when(c, 1))
    out = rows.agg(n(both).alias("both"), n(F.col("b").isNull()).alias("left_only"), n(F.col("a").isNull()).alias("right_only"), n(bad).alias("differing"), F.max(F.when(both, F.abs(F.col("a") - F.col("b")))).alias("max_abs_diff"))
    return out.withColumn("equal", (F.col("left_only") + F.col("right_only") + F.col("differing")) == 0)


def worst_cells(left: DataFrame, right: DataFrame, keys: list[str] | None = None, k: int = 20) -> DataFrame:
    """The k cells of greatest difference, missing ones first."""
    keys = keys or ["e", "m"]
    rows = compared(left, right, keys).withColumn("gap", F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(float("inf")))))
    return rows.where("gap > 0").orderBy(F.desc("gap"), *keys).limit(k)


def validate_factors(left: DataFrame, right: DataFrame, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """A report for each factor of two long tables (e, m, factor, value); a factor in one table only is a failure."""
    rows = compared(left, right, ["factor", "e", "m"])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    report = rows.groupBy("factor").agg(n(both).alias("both"), n(F.col("b").isNull()).alias("left_only"), n(F.col("a").isNull()).alias("right_only"), n(both & differs(F.col("a"), F.col("b"), atol, rtol)).alias("differing"))
    return report.withColumn("passed", (F.col("both") > 0) & (F.col("left_only") + F.col("right_only") + F.col("differing") == 0))


def choose_universe(native: DataFrame, reference: DataFrame, flags: DataFrame, policies: dict[str, str], atol: float = 1e-6) -> DataFrame:
    """(policy, mismatches) of masks, as SQL conditions on ``flags``, under which a panel equals its reference; best first."""
    rows = compared(native.join(flags.select("e", "m"), ["e", "m"], "left_semi"), reference, ["e", "m"]).join(flags, ["e", "m"], "left")
    wrong = []
    for name, condition in policies.items():
        a = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.col("a"))
        bad = (a.isNull() != F.col("b").isNull()) | F.coalesce(differs(a, F.col("b"), atol), F.lit(False))
        wrong.append(F.count(F.when(bad, 1)).alias(name))
    counts = rows.agg(*wrong)
    return counts.unpivot([], list(policies), "policy", "mismatches").orderBy("mismatches", "policy")


def compare_vintages(old: DataFrame, new: DataFrame, keys: list[str], atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """For each common column: rows in both vintages, and the share of them that changed; keys gone and new as rows too."""
    columns = [c for c in old.columns if c in new.columns and c not in keys]
    numeric = {c for c, t in old.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    a = old.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = new.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    rows = a.join(b, keys, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def changed(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c not in numeric:
            return ~x.eqNullSafe(y)
        gap = F.abs(x.cast("double") - y.cast("double"))
        return (x.isNull() != y.isNull()) | F.coalesce((gap > atol) & (gap > rtol * F.abs(x.cast("double"))), F.lit(False))

    n = lambda cond: F.count(F.when(cond, 1))
    sums = rows.agg(n(both).alias("common"), n(F.col("in_b").isNull()).alias("gone"), n(F.col("in_a").isNull()).alias("added"), *(n(both & changed(c)).alias(f"c_{c}") for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("changed")) for c in columns))
    return sums.select("common", "gone", "added", F.explode(pairs).alias("p")).select("p.column", "common", "gone", "added", "p.changed", (F.col("p.changed") / F.col("common")).alias("share_changed"))


def schema_changes(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns that went, came or changed their type."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return sorted([f"- {c} {a[c]}" for c in a if c not in b] + [f"+ {c} {b[c]}" for c in b if c not in a] + [f"~ {c} {a[c]} {b[c]}" for c in a if c in b and a[c] != b[c]])


def classify_factors(old: DataFrame, new: DataFrame, frontier: int, minor: float = 0.01, suspect: float = 0.2, atol: float = 1e-6) -> DataFrame:
    """(factor, verdict) of two long tables: identical, restated early and little, restated, or suspect.

    Cells up to month ``frontier`` count: later ones are new data.  A factor is suspect if more than ``suspect`` of its
    old cells changed or went; a restatement of at most ``minor`` is minor.
    """
    rows = compared(old.where(F.col("m") <= frontier), new.where(F.col("m") <= frontier), ["factor", "e", "m"])
    had = F.col("a").isNotNull()
    bad = had & (F.col("b").isNull() | differs(F.col("a"), F.col("b"), atol, atol))
    out = rows.groupBy("factor").agg(F.count(F.when(had, 1)).alias("cells"), F.count(F.when(bad, 1)).alias("changed"), F.count(F.when(~had, 1)).alias("added"))
    share = F.col("changed") / F.greatest("cells", F.lit(1))
    verdict = F.when((F.col("changed") == 0) & (F.col("added") == 0), "identical").when(share > suspect, "suspect").when(share <= minor, "restated_minor").otherwise("restated")
    return out.withColumn("share", share).withColumn("verdict", verdict)


def freeze(panel: DataFrame, path: str) -> None:
    """Keep a panel as the baseline for later comparisons."""
    panel.write.mode("errorifexists").option("compression", "zstd").parquet(path)
