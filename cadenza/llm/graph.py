"""Connected components of an edge table, without gathering edges or labels on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, materialize


#: Edges that one task connects, whatever their shape.
ONE_TASK = 1000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge, component being the least node that it is connected to.

    ``edges`` has bigint columns a and b.  Each round sends every node to the least of itself and its neighbours, and only
    edges between different images go on, each once; so the edges of stars and blocks are joined once, not in every round.
    The first round takes nodes in the order of their ids, as edges mostly lead to the least member; the others order
    them by their exclusive or with a random number, where any node is as likely before another as after it, so that of
    the nodes three quarters are left at most, on average.  Minima are partially aggregated, joins are plain equi-joins
    which Spark may split at hot nodes, and the tables of each round lie in the shared folder.  One task ends the work
    once at most ``ONE_TASK`` edges are left.
    """
    some = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = materialize(some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rng, steps, n_rounds = np.random.default_rng(5), [], 0
    while left.limit(ONE_TASK + 1).count() > ONE_TASK:
        if n_rounds == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        mask = F.lit(int(rng.integers(-(1 << 63), 1 << 63)) if n_rounds else 0).cast("bigint")
        n_rounds += 1
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = ends.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("near"))
        steps.append(materialize(nearest.select(F.col("a").alias("node"), F.least(F.col("a").bitwiseXOR(mask), "near").bitwiseXOR(mask).alias("label")), "labels"))
        images = left.join(steps[-1].toDF("a", "x"), "a").join(steps[-1].toDF("b", "y"), "b").where("x <> y")
        fresh = materialize(images.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = fresh
    found = materialize(left.coalesce(1).mapInPandas(_labels, "node bigint, label bigint"), "labels")
    discard(left)
    while steps:
        step, beyond = steps.pop(), found.toDF("via", "beyond")
        fresh = materialize(step.join(beyond, F.col("label") == F.col("via"), "left").select("node", F.coalesce("beyond", "label").alias("label")), "labels")
        discard(step)
        discard(found)
        found = fresh
    if n_rounds <= 1:  # in the order of ids, labels are the least nodes
        return found.withColumnRenamed("label", "component")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, label) of few edges: the least node that each is connected to."""
    edges = [x for batch in batches for x in batch[["a", "b"]].to_numpy(np.int64)]
    nodes, of = np.unique(np.array(edges, np.int64).reshape(-1, 2), return_inverse=True)
    of = of.reshape(-1, 2)
    yield pd.DataFrame({"node": nodes, "label": nodes[least_rows(len(nodes), of[:, 0], of[:, 1])]})


def least_rows(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that pairs (i, j) connect it to."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        np.minimum.at(least, root, least)
        least = least[least]
        if (least == root).all():
            return root
        root = least
