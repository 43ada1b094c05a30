"""Driver queries of the library's own operators, on the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.oracles import catalogue, evaluation, kernels, panel, regressions  # noqa: F401 (adds its cases)
from cadenza.plans.compiler import Library
from cadenza.plans.expr import Expr
from cadenza.sources.standins import standins

Query = Callable[[SparkSession, str], DataFrame]


def rounded(v: Column) -> Column:
    """Six places, with ties where no short decimal lies; see the SQL side."""
    return F.when(F.abs(v) < 1e12, F.floor(v * F.lit(1e6) + F.lit(0.50123)).cast("double") / F.lit(1e6)).otherwise(v)


def evaluated(tree: Expr) -> Query:
    """(e, m, value) of one tree, rounded for comparison with another engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = Library(standins(spark, sf_dir)).wide({"v": tree})
        return wide.where("v IS NOT NULL").select("e", "m", rounded(F.col("v")).alias("value"))

    return run


def queries() -> dict[str, Query]:
    found = {name: evaluated(source.tree(name)) for source in (panel, kernels) for name in source.CASES}
    return found | evaluation.QUERIES | {"catalogue__flagship": flagship_rounded} | {name: group(names) for name, names in catalogue.GROUPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for source in (panel, kernels) for name, (_, sql) in source.CASES.items() if sql} | evaluation.SQL | catalogue.SQL | {"catalogue__flagship": panel.flagship()}


def group(names: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from cadenza.plans.catalog import factor

        return Library(standins(spark, sf_dir)).long({n: factor(n) for n in names}).select("e", "m", "factor", rounded(F.col("value")).alias("value"))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.plans.catalog import factor

    names = ("AM", "AssetGrowth", "Mom12m", "Size", "STreversal")
    return Library(standins(spark, sf_dir)).long({n: factor(n) for n in names})


def flagship_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).select("e", "m", "factor", rounded(F.col("value")).alias("value"))
