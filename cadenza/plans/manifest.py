"""Incremental builds: a factor whose recipe and inputs have not changed since its last build is skipped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.compiler import Library
from cadenza.plans.expr import Expr


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """Digest of the names, sizes and times of the files below the inputs, through Hadoop's file systems."""
    parts = []
    for p in sorted(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            s = found.next()
            parts.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return blake2b("\n".join(sorted(parts)).encode(), digest_size=16).hexdigest()


def recipe_key(tree: Expr, inputs: str, version: str = "1") -> str:
    return blake2b(f"{tree.key}:{inputs}:{version}".encode(), digest_size=16).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    try:
        return {r["factor"]: r["key"] for r in spark.read.json(path).groupBy("factor").agg(F.max(F.struct("at", "key")).getField("key").alias("key")).collect()}
    except Exception as error:  # no manifest yet
        if "PATH_NOT_FOUND" in str(error):
            return {}
        raise


def waves(trees: Mapping[str, Expr], most_factors: int = 14, most_nodes: int = 250) -> list[list[str]]:
    """Factors that are evaluated together: those that share most sub-expressions, within a budget of columns."""
    left = {name: frozenset(tree.nodes()) for name, tree in trees.items()}
    out = []
    while left:
        first = next(iter(left))
        wave, nodes = [first], set(left.pop(first))
        while left and len(wave) < most_factors:
            best = max(left, key=lambda n: (len(left[n] & nodes) / max(1, len(left[n])), -len(left[n])))
            if len(nodes | left[best]) > most_nodes:
                break
            wave.append(best)
            nodes |= left.pop(best)
        out.append(wave)
    return out


def build(library: Library, spark: SparkSession, trees: Mapping[str, Expr], folder: str, inputs: Iterable[str], incremental: bool = True, log: Callable[[str], None] = print) -> dict[str, str]:
    """Build factors into ``folder``; returns their fates: built, current, or the error that kept one from being built.

    Factors are evaluated in waves, one wide select each, so that what they share is computed once.  If a wave fails, its
    factors are built one by one, so that one failure leaves the others alone.
    """
    version = fingerprint(spark, inputs)
    known = read_manifest(spark, f"{folder}/manifest") if incremental else {}
    keys = {name: recipe_key(tree, version) for name, tree in trees.items()}
    fates = {name: "current" for name in trees if known.get(name) == keys[name]}

    def attempt(names: list[str]) -> str | None:
        """The error that kept these factors from being built, if any did."""
        try:
            for name in names:
                _delete(spark, f"{folder}/factor={name}")
            rows = library.long({n: trees[n] for n in names}).select("e", "m", F.col("value").cast("float").alias("value"), "factor")
            rows.write.mode("append").option("compression", "zstd").partitionBy("factor").parquet(folder)
            made = spark.createDataFrame([(n, keys[n]) for n in names], "factor string, key string")
            made.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{folder}/manifest")
        except Exception as error:
            return str(error)[:200]
        return None

    for wave in waves({n: t for n, t in trees.items() if n not in fates}):
        failed = attempt(wave)
        for name in wave:
            error = attempt([name]) if failed and len(wave) > 1 else failed
            fates[name] = f"failed: {error}" if error else "built"
            log(f"{name}: {fates[name]}")
    return fates


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def describe(trees: Mapping[str, Expr]) -> str:
    """The trees as a Graphviz graph of datasets, columns and factors."""
    edges = set()
    for name, tree in trees.items():
        for node in tree.nodes().values():
            if node.kind == "var":
                edges |= {(node.name.split(".")[0], node.name), (node.name, name)}
    return "digraph {\n" + "\n".join(f"  {json.dumps(a)} -> {json.dumps(b)};" for a, b in sorted(edges)) + "\n}"


def status(trees: Mapping[str, Expr], operators: Iterable[str]) -> list[tuple[str, bool, list[str]]]:
    """For each factor whether all its operators exist, and those that do not."""
    known = set(operators)
    return [(n, not (missing := sorted({x.name for x in t.nodes().values() if x.kind == "op"} - known)), missing) for n, t in trees.items()]


def read_factors(spark: SparkSession, folder: str, factors: list[str] | None = None) -> DataFrame:
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/factor=*")
    return rows.where(F.col("factor").isin(factors)) if factors else rows
