"""Appending new vendor rows to a legacy table: code crosswalks, derived columns, and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange letters and their codes.
EXCHANGES = {"N": 1, "A": 2, "Q": 3, "R": 4}


def mapped(code: Column, table: dict) -> Column:
    """A code by a small table; others become missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def share_code(kind: Column, type_: Column, issuer: Column, home: Column) -> Column:
    """Two-digit share code from security kind, share type, issuer type and domicile."""
    common = (kind == "COM") & (type_ == "NS")
    return F.when(common & (issuer == "CORP") & (home == "Y"), 11).when(common & (home == "N"), 12).when(common, 10).otherwise(F.lit(None).cast("int"))


def distribution_digits(distcd: Column) -> list[Column]:
    """The four digits of a distribution code."""
    code = distcd.cast("int")
    return [(F.floor(code / 10 ** (3 - k)) % 10).cast("int").alias(f"cd{k + 1}") for k in range(4)]


def append(legacy: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Legacy rows and those fresh ones whose keys are new, in the legacy schema, which has to be covered."""
    missing = sorted(set(legacy.columns) - set(fresh.columns))
    if missing:
        raise ValueError(f"fresh rows lack {', '.join(missing)}")
    same = fresh.select(*(F.col(c).cast(t).alias(c) for c, t in legacy.dtypes))
    return legacy.unionByName(same.join(legacy.select(*keys), keys, "left_anti"))


def month_from_days(days: DataFrame) -> DataFrame:
    """(e, m, ret, vol): returns compounded and volumes added, missing if all are."""
    m = F.year("d") * 12 + F.month("d") - 1
    return days.groupBy("e", m.alias("m")).agg(F.when(F.count("ret") > 0, F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"), F.sum("vol").alias("vol"))


def market_returns(stocks: DataFrame) -> DataFrame:
    """(m, vwretd, ewretd, usdval): means weighted by last month's size, and unweighted."""
    before = stocks.select("e", (F.col("m") + 1).alias("m"), F.col("mve_c").alias("size"))
    rows = stocks.join(before, ["e", "m"], "left")
    weight = F.when(F.col("ret").isNotNull(), F.col("size"))
    return rows.groupBy("m").agg((F.sum(weight * F.col("ret")) / F.sum(weight)).alias("vwretd"), F.avg("ret").alias("ewretd"), F.sum("size").alias("usdval"))
