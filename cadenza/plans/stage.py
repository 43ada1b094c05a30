"""A panel under construction: a spine of (e, m) rows to which operators add columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]


class Stage:
    """``df`` has bigint e (entity), int m (year * 12 + month - 1) and the columns made so far.

    ``let`` names a column, so that windows can be taken over it; consecutive windows over one entity share one shuffle
    and one sort, since all of them are partitioned by e and ordered by m.
    """

    def __init__(self, df: DataFrame, tables: Tables | None = None):
        self.df, self.tables, self._count = df, tables, 0

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def table(self, name: str) -> DataFrame:
        if self.tables is None:
            raise LookupError(f"no tables for {name}")
        return self.tables(name)

    def let(self, column: Column, hint: str = "v") -> Column:
        self._count += 1
        name = f"_{hint}{self._count}"
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    def attach(self, values: DataFrame) -> Column:
        """A column from rows (e, m, value), at most one for each (e, m)."""
        self._count += 1
        name = f"_k{self._count}"
        self.df = self.df.join(values.select("e", "m", F.col("value").alias(name)), ["e", "m"], "left")
        return F.col(name)

    def rows(self, *columns: Column, names: Iterable[str]) -> DataFrame:
        """Present columns under other names, with e and m."""
        return self.df.select("e", "m", *(c.alias(n) for c, n in zip(columns, names, strict=True)))

    @property
    def along(self) -> WindowSpec:
        return W.partitionBy("e").orderBy("m")

    @property
    def until(self) -> WindowSpec:
        return self.along.rowsBetween(W.unboundedPreceding, 0)

    def months(self, first: int, last: int) -> WindowSpec:
        """Calendar months m + first .. m + last."""
        return self.along.rangeBetween(first, last)

    def across(self, *keys: Column | str) -> WindowSpec:
        return W.partitionBy("m", *keys)

    def lag(self, x: Column, n: int) -> Column:
        """Value n calendar months earlier; gaps are not bridged."""
        return self.let(F.max(x).over(self.months(-n, -n)), "lag")

    def delta(self, x: Column, n: int) -> Column:
        return x - self.lag(x, n)
