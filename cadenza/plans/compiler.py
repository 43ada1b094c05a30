"""From expression trees to one DataFrame.

Trees are interned by structural hash, so a sub-expression that several factors share becomes one column.  Leaves of one
table are read by one aggregate and one join, whatever their number, and those of the spine's tables by its own.  Everything after the spine is a column of one
growing select: Catalyst merges the projections, and windows of one entity share a shuffle and a sort.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import operators
from cadenza.functions.ieee import clean
from cadenza.operators.relational import first_by
from cadenza.plans.expr import Expr
from cadenza.plans.stage import Stage, Tables
from cadenza.sources.sinks import written

#: Datasets by the way their rows reach an entity's month.
FIRM = ("statement_quarter",)
TICKER = ("estimates", "estimates_adjusted", "recommendations", "actuals")
EVENT = ("distributions",)


#: Datasets whose rows make up the spine and its flags.
SPINE = ("stock_month", "statement_month")


def spine(tables: Tables, reach: int, leaves: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Months of each entity from its first to ``reach`` after its last, up to the last month of all, with row flags.

    ``leaves``: columns of the tables of ``SPINE`` that come along, from the same aggregates as the flags.
    """
    columns = {d: [_value(tables(d), c).alias(f"{d}__{c}") for c in (leaves or {}).get(d, [])] for d in SPINE}
    strict = F.max(F.coalesce(F.col("shrcd").isin(10, 11, 12) & F.col("exchcd").isin(1, 2, 3), F.lit(False)))
    rows = tables("stock_month").groupBy("e", "m").agg(strict.alias("strict"), F.lit(True).alias("listed"), *columns["stock_month"])
    ends = tables("stock_month").groupBy("e").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    last = F.broadcast(ends.agg(F.max("hi").alias("end")))
    months = ends.crossJoin(last).select("e", F.explode(F.sequence("lo", F.least(F.col("hi") + reach, "end"))).alias("m"))
    statement = tables("statement_month").where("e IS NOT NULL").groupBy("e", "m").agg(F.lit(True).alias("compustat"), *columns["statement_month"])
    firm = tables("universe").where("firm IS NOT NULL").select("e", "m").distinct().withColumn("linked", F.lit(True))
    joined = months.join(rows, ["e", "m"], "left").join(statement, ["e", "m"], "left").join(firm, ["e", "m"], "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("strict", "listed", "compustat", "linked")}
    return joined.select("e", "m", *(v.alias(k) for k, v in flags.items()), *(c for c in joined.columns if "__" in c))


def _value(df: DataFrame, column: str, event: bool = False) -> Column:
    """One value for each cell: doubles, or strings where they are strings; dates become month numbers."""
    kind = dict(df.dtypes)[column]
    value = F.col(column) if kind == "string" else clean(F.year(column) * 12 + F.month(column) - 1 if kind == "date" else F.col(column))
    return F.sum(value) if event and column == "divamt" else F.max(value)


def _filtered(df: DataFrame, params: tuple[tuple[str, object], ...]) -> DataFrame:
    for column, value in params:
        df = df.where(F.col(column).isNotNull() if value == "*" else F.col(column) == F.lit(value))
    return df


def leaf_rows(tables: Tables, dataset: str, columns: list[str], params: tuple[tuple[str, object], ...] = ()) -> DataFrame:
    """(e, m, columns): one row for each cell; columns are doubles, or strings where they are strings."""
    df = _filtered(tables(dataset), params)
    if dataset in FIRM:
        owner = first_by(tables("universe").where("firm IS NOT NULL").select("e", "m", "firm"), ["firm", "m"], "e")
        df = df.join(owner, ["firm", "m"])
    elif dataset in TICKER:
        df = df.join(first_by(tables("universe").where("ticker IS NOT NULL").select("e", "m", "ticker"), ["ticker", "m"], "e"), ["ticker", "m"])
    return df.groupBy("e", "m").agg(*(_value(df, c, dataset in EVENT).alias(c) for c in columns))


class Library:
    """Evaluates trees over a set of tables."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def stage(self, trees: Mapping[str, Expr]) -> tuple[Stage, dict[str, Column]]:
        nodes: dict[str, Expr] = {}
        for tree in trees.values():
            nodes |= tree.nodes()
        made: dict[str, Column] = {}
        leaves: dict[tuple, list[Expr]] = {}
        for node in nodes.values():
            if node.kind == "var":
                leaves.setdefault((node.name.split(".")[0], node.params), []).append(node)
        named = {key: sorted({n.name.split(".")[1] for n in group}) for key, group in leaves.items()}
        reach = min(600, max((t.reach for t in trees.values()), default=0))
        stage = Stage(spine(self.tables, reach, {d: named[d, ()] for d in SPINE if (d, ()) in named}), self.tables)
        for k, ((dataset, params), group) in enumerate(leaves.items()):
            prefix = f"{dataset}__"
            if dataset not in SPINE or params:
                prefix = f"_l{k}_"
                rows = leaf_rows(self.tables, dataset, named[dataset, params], params).withColumnsRenamed({c: prefix + c for c in named[dataset, params]})
                stage.df = stage.df.join(rows, ["e", "m"], "left")
            for n in group:
                made[n.key] = F.col(prefix + n.name.split(".")[1])
        # Operators that write rows evaluate the stage on the spot: they come first, so that what others attach is not
        # evaluated again for each of them, and start from a spine that is written once.
        early: dict[str, Expr] = {}
        for node in nodes.values():
            if node.kind == "op" and node.name in operators.WRITING:
                early |= node.nodes()
        if early:
            stage.df = written(stage.df, "spine")
        nodes = early | nodes
        for key, node in nodes.items():
            if node.kind == "const":
                made[key] = F.lit(node.value)
            elif node.kind == "op":
                column = operators.apply(node.name, stage, *(made[a.key] for a in node.args), **dict(node.params))
                made[key] = stage.let(column, "n")
        return stage, {name: made[tree.key] for name, tree in trees.items()}

    def wide(self, trees: Mapping[str, Expr]) -> DataFrame:
        """(e, m) and one column for each tree; rows without any value are left out."""
        stage, columns = self.stage(trees)
        some = F.coalesce(*(c.cast("double") for c in columns.values())).isNotNull()
        return stage.df.where(some).select("e", "m", *(clean(c).alias(n) for n, c in columns.items()))

    def long(self, trees: Mapping[str, Expr]) -> DataFrame:
        """(e, m, factor, value): one row for each present cell."""
        wide = self.wide(trees)
        return wide.unpivot(["e", "m"], list(trees), "factor", "value").where("value IS NOT NULL")
