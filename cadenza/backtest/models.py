"""Models behind one interface: fit on a DataFrame of feature columns and a label, predict on another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moment_matrix(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Sums of products of (1, names): each batch of rows gives one matrix, and entries are added up by place.

    What reaches the driver is one matrix, whatever the number of rows or partitions.
    """
    k = len(names) + 1

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for part in parts:
            x = np.column_stack([np.ones(len(part)), part.to_numpy(float)])
            total += x.T @ x
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = rows.select(*names).mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((k, k))
    out[sums["i"], sums["j"]] = out[sums["j"], sums["i"]] = sums["s"]
    return out


class Ridge:
    """Linear model with centred features and penalty alpha on the slopes."""

    def __init__(self, alpha: float = 1.0):
        self.alpha, self.names, self.coef, self.intercept = alpha, None, None, None

    def fit(self, rows: DataFrame, names: list[str], label: str = "label") -> Ridge:
        m = moment_matrix(rows, [*names, label])
        if not m[0, 0]:
            raise ValueError("no training rows")
        n, mean, p = m[0, 0], m[0, 1:] / m[0, 0], len(names)
        centred = m[1:, 1:] - n * np.outer(mean, mean)
        self.coef = np.linalg.solve(centred[:p, :p] + self.alpha * np.eye(p), centred[:p, p])
        self.intercept = mean[p] - self.coef @ mean[:p]
        self.names = list(names)
        return self

    def predict(self, rows: DataFrame, output: str = "score") -> DataFrame:
        if self.coef is None:
            raise RuntimeError("predict before fit")
        value = F.lit(float(self.intercept))
        for c, n in zip(self.coef, self.names, strict=True):
            value = value + F.lit(float(c)) * F.col(n)
        return rows.withColumn(output, value)


class BoostedTrees:
    """Gradient-boosted regression trees of Spark's machine-learning library."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.05, seed: int = 42):
        self.params, self.model, self.names = {"maxIter": trees, "maxDepth": depth, "stepSize": rate, "seed": seed}, None, None

    def fit(self, rows: DataFrame, names: list[str], label: str = "label") -> BoostedTrees:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        self.names = list(names)
        data = VectorAssembler(inputCols=self.names, outputCol="features").transform(rows)
        if data.isEmpty():
            raise ValueError("no training rows")
        self.model = GBTRegressor(featuresCol="features", labelCol=label, **self.params).fit(data)
        return self

    def predict(self, rows: DataFrame, output: str = "score") -> DataFrame:
        if self.model is None:
            raise RuntimeError("predict before fit")
        from pyspark.ml.feature import VectorAssembler

        data = VectorAssembler(inputCols=self.names, outputCol="features").transform(rows)
        return self.model.transform(data).withColumnRenamed("prediction", output).drop("features")


class Perceptron:
    """Two hidden layers trained by Adam in one task, on at most ``sample`` rows of least hash; numpy only.

    Scoring is a vectorised function over Arrow batches.
    """

    def __init__(self, hidden: tuple[int, int] = (64, 32), epochs: int = 60, rate: float = 1e-3, patience: int = 5, sample: int = 200_000, seed: int = 42):
        self.hidden, self.epochs, self.rate, self.patience, self.sample, self.seed, self.layers, self.names = hidden, epochs, rate, patience, sample, seed, None, None

    def fit(self, rows: DataFrame, names: list[str], label: str = "label") -> Perceptron:
        self.names = list(names)
        keys = [c for c in ("date", "stock") if c in rows.columns] or names
        data = rows.orderBy(F.xxhash64(*keys)).limit(self.sample).select(*keys, *names, label).toPandas().sort_values(keys)
        if not len(data):
            raise ValueError("no training rows")
        self.layers = self._train(data[names].to_numpy(float), data[label].to_numpy(float))
        return self

    def _train(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        cut = max(1, int(0.9 * len(x)))  # the last tenth, in order of date, stops the training
        sizes = [x.shape[1], *self.hidden, 1]
        layers = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        state = [[np.zeros_like(p), np.zeros_like(p)] for layer in layers for p in layer]
        best, kept, waited, step = np.inf, [[p.copy() for p in layer] for layer in layers], 0, 0
        held_x, held_y = (x[cut:], y[cut:]) if cut < len(x) else (x, y)
        for _ in range(self.epochs):
            for batch in np.array_split(rng.permutation(cut), max(1, cut // 256)):
                step += 1
                acts = [x[batch]]
                for k, (w, b) in enumerate(layers):
                    z = acts[-1] @ w + b
                    acts.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
                grad = 2 * (acts[-1] - y[batch, None]) / len(batch)
                grads = []
                for k in range(len(layers) - 1, -1, -1):
                    grads[:0] = [acts[k].T @ grad, grad.sum(axis=0)]
                    if k:
                        grad = (grad @ layers[k][0].T) * (acts[k] > 0)
                for (m, v), g, (i, j) in zip(state, grads, [(i, j) for i in range(len(layers)) for j in (0, 1)], strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    layers[i][j] -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            loss = float(((forward(held_x, layers) - held_y) ** 2).mean())
            if loss < best - 1e-9:
                best, kept, waited = loss, [[p.copy() for p in layer] for layer in layers], 0
            elif (waited := waited + 1) >= self.patience:
                break
        return [tuple(layer) for layer in kept]

    def predict(self, rows: DataFrame, output: str = "score") -> DataFrame:
        if self.layers is None:
            raise RuntimeError("predict before fit")
        layers = self.layers

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(forward(np.column_stack([c.to_numpy(float) for c in columns]), layers))

        return rows.withColumn(output, score(*(F.col(n) for n in self.names)))


def forward(x: np.ndarray, layers: list) -> np.ndarray:
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x[:, 0]
