"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are normalised in double precision and equal ones collapse into a class.  A random rotation turns a vector into
signs.  Stored for each class are the bits of the signs, a correction factor (the inner product of the rotated vector
with its own sign vector), and the rotated vector itself, rounded at random to ``LEVELS`` steps and kept as bit planes.
For a pair, the inner product of one side's rounded vector with the other's signs, divided by the other's factor, is an
unbiased estimate of the cosine; it takes bit counts only.  Factor and step give the width of its confidence interval.
Pairs whose upper bound is below the threshold are dropped.  The vectors of the others, and no more, are fetched, and
their cosines recomputed exactly, in double precision.

Which pairs meet is decided by ``tables`` independent sets of hyperplane bits: pairs that agree on all bits of some
table are in one bucket.  Bits grow with the logarithm of the number of classes, and the number of tables follows from
the bits, so that a pair at the threshold is missed with probability ``miss`` at most, at every size; pairs above it are
missed more rarely.  Buckets are cut into blocks of ``BLOCK`` rows; each pair of blocks is a task's unit, so a bucket of
any size is spread out.  A pair that several tables find is counted by the first of them only.  Units return the rows
with open pairs, then counts of links and a spanning forest of the linked rows, never the pairs themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal vectors link with each other (cosine 1); rows that repeat a vec_id are one
node of the graph, each with the links of its own vector; null ids are returned with no links; an empty table gives an empty result;
only the id and embedding columns are read, so labels and other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, materialize, tidy
from cadenza.llm.graph import components, least_rows

THRESHOLD = 0.9
MISS = 0.002
#: Rows of a block; a unit of work holds two blocks.
BLOCK = 512
#: Classes that share a bucket on average, beyond which another bit is taken.
PER_BUCKET = 256
#: Rows of units that are compared in one call, on average.
ROWS_PER_CALL = 4000
#: Bit planes of a rounded vector, and the steps that they tell apart.
PLANES = 4
LEVELS = 1 << PLANES
#: Width of the confidence interval in standard deviations of the estimate.
SIGMAS = 4.0
SEED = 20240607


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan_tables(classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = max(4, math.ceil(math.log2(max(2, classes) / PER_BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


@cache
def _planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, 1, dim]).normal(size=(dim, n))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers (rows, tables) of unit vectors."""
    on = (x @ _planes(x.shape[1], bits * tables) > 0).reshape(len(x), tables, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


class Codes:
    """What is stored of unit vectors: bits of the signs, factors, and the rounded rotated vectors in bit planes."""

    def __init__(self, bits: np.ndarray, planes: np.ndarray, numbers: np.ndarray, dim: int):
        self.bits, self.planes, self.dim = bits, planes, dim  # (rows, words), (rows, PLANES, words)
        self.factor, self.low, self.step, self.total = numbers.T.astype(np.float64)

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        dim = x.shape[1]
        turned = x @ rotation(dim)
        signs = turned > 0
        factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum(high - low, 1e-12) / (LEVELS - 1)
        # Rounded up or down at random, by as much as is missing: unbiased.
        chance = np.random.default_rng([SEED, 2, dim]).random(dim)
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + chance), 0, LEVELS - 1).astype(np.uint8)
        planes = np.stack([_words(level >> k & 1) for k in range(PLANES)], axis=1)
        return cls(_words(signs), planes, np.stack([factor, low, step, turned.sum(axis=1)], axis=1).astype(np.float32), dim)

    def packed(self) -> list[bytes]:
        """One byte string for each row."""
        numbers = np.stack([self.factor, self.low, self.step, self.total], axis=1).astype(np.float32)
        return [b.tobytes() + p.tobytes() + n.tobytes() for b, p, n in zip(self.bits, self.planes, numbers, strict=True)]

    @classmethod
    def unpacked(cls, rows: list[bytes], dim: int) -> Codes:
        words = -(-dim // 64)
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        cut = np.split(raw, [8 * words, 8 * words * (1 + PLANES)], axis=1)
        bits, planes = (np.ascontiguousarray(c).view(np.uint64) for c in cut[:2])
        return cls(bits, planes.reshape(len(rows), PLANES, words), np.ascontiguousarray(cut[2]).view(np.float32), dim)

    def estimates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(left, right) estimates of the cosines, from bit counts."""
        on = np.bitwise_count(self.bits[right]).sum(axis=1).astype(np.float64)
        inner = np.zeros((len(left), len(right)))
        for k in range(PLANES):
            inner += np.bitwise_count(self.planes[left, k][:, None, :] & self.bits[right][None]).sum(axis=2, dtype=np.int32) * float(1 << k)
        positive = self.low[left, None] * on + self.step[left, None] * inner
        return (2 * positive - self.total[left, None]) / math.sqrt(self.dim) / np.maximum(self.factor[right], 1e-9)

    def margins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Half the width of the confidence interval of each estimate."""
        f = np.maximum(self.factor[right], 1e-9)
        spread = np.maximum(0, 1 - f**2) / f**2 / max(1, self.dim - 1)
        return SIGMAS * np.sqrt(spread[None, :] + (self.step[left, None] / 2 / f[None, :]) ** 2) + 1e-3


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, zeros at the end."""
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def first_tables(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the first table in which both rows of each pair are in one bucket."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 65536):
        k = slice(a, a + 65536)
        out[k] = (sig[i[k]] == sig[j[k]]).argmax(axis=1)
    return out


def _usable(values: list | None, dtype: type) -> np.ndarray | None:
    if not values or any(c is None for c in values):
        return None
    v = np.asarray(values, dtype)
    return v if np.isfinite(v).all() and v.any() else None


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1; dividing by the largest component first avoids overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(rows: DataFrame, dtype: type) -> DataFrame:
    """Rows (id, v, key): v the components as bytes and key their digest; unusable vectors have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_usable(x, dtype) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v.tobytes() for v in found], pa.binary())], names=["id", "v"])

    return rows.mapInArrow(tidy(run), "id bigint, v binary").withColumn("key", F.sha2("v", 256))


def _stored(groups: DataFrame, dtype: type, bits: int, tables: int) -> DataFrame:
    """Rows (cls, code, sig, buckets): the packed code, and the bucket of each table, as bytes and as keys."""
    kind = _sig_type(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, dtype) for b in batch.column(1).to_pylist()]
            for dim in sorted({len(v) for v in found}):
                at = [i for i, v in enumerate(found) if len(v) == dim]
                x = unit_rows(np.stack([found[i] for i in at]))
                sig = signatures(x, bits, tables)
                keys = (np.arange(tables, dtype=np.int64) << 48) + (sig << 16) + dim
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(Codes.of(x).packed(), pa.binary()), pa.array([r.tobytes() for r in sig.astype(kind)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["cls", "code", "sig", "buckets"],
                )

    return groups.select("cls", "v").mapInArrow(tidy(run), "cls bigint, code binary, sig binary, buckets array<bigint>")


def _sig_type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def _cells(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of each unit: those of one block among themselves, or of two blocks across.  ``df`` is sorted by unit."""
    unit = (df[["bucket", "lo", "hi"]].diff() != 0).any(axis=1).to_numpy().cumsum()
    block, lo, hi = (df[c].to_numpy() for c in ("block", "lo", "hi"))
    for a, b in pairwise([*np.flatnonzero(np.diff(unit, prepend=-1)).tolist(), len(df)]):
        rows = np.arange(a, b)
        yield (rows, None) if lo[a] == hi[a] else (rows[block[a:b] == lo[a]], rows[block[a:b] == hi[a]])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row."""
    dtype = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    rows = materialize(_packed(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding")), dtype), "vectors")
    usable = rows.where("key IS NOT NULL AND id IS NOT NULL")
    groups = usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = materialize(groups.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    n = groups.count()
    bits, tables = plan_tables(n, threshold, miss)
    stored = materialize(_stored(groups, dtype, bits, tables), "vector-codes")
    kind = _sig_type(bits)
    spots = stored.select("cls", F.explode("buckets").alias("bucket"))
    sizes = spots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = spots.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls", "bucket"), "blocks").cast("int"))
    # A row of block i goes to the units (i, j) and (j, i) of every block j; the larger number is named second.
    units = placed.select("cls", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("cls", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    calls = max(1, n * tables // ROWS_PER_CALL)
    call = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(calls)).alias("call")
    order = ["bucket", "lo", "hi", "cls"]

    def opened(df: pd.DataFrame) -> pd.DataFrame:
        """Rows with a pair that this table is the first to find and that the bounds leave open."""
        df = df.sort_values(order, ignore_index=True)
        table, dims = df["bucket"].to_numpy() >> 48, df["bucket"].to_numpy() & 0xFFFF
        keep = np.zeros(len(df), bool)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            part = df.iloc[own].reset_index(drop=True)
            code = Codes.unpacked(part["code"].tolist(), dim)
            sig = np.frombuffer(b"".join(part["sig"]), kind).reshape(len(part), -1)
            for left, right in _cells(part):
                other = left if right is None else right
                i, j = np.nonzero(code.estimates(left, other) + code.margins(left, other) >= threshold)
                i, j = left[i], other[j]
                if right is None:
                    i, j = i[i < j], j[i < j]
                fresh = first_tables(sig, i, j) == table[own[left[0]]] if len(i) else np.zeros(0, bool)
                keep[own[i[fresh]]] = keep[own[j[fresh]]] = True
        return df.loc[keep, ["cls", "bucket", "block", "lo", "hi"]]

    kinds = "cls bigint, bucket bigint, block int, lo int, hi int"
    coded = units.join(stored.select("cls", "code", "sig"), "cls")
    left_open = materialize(coded.groupBy(call).applyInPandas(opened, kinds), "vector-open")

    def linked(df: pd.DataFrame) -> pd.DataFrame:
        """Exact cosines of a unit's rows with open pairs: links of each, and the least row that it is connected to."""
        df = df.sort_values(order, ignore_index=True)
        table, dims = df["bucket"].to_numpy() >> 48, df["bucket"].to_numpy() & 0xFFFF
        rep, copies = df["rep"].to_numpy(), df["copies"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            part = df.iloc[own].reset_index(drop=True)
            x = unit_rows(np.frombuffer(b"".join(part["v"]), dtype).reshape(-1, dim))
            sig = np.frombuffer(b"".join(part["sig"]), kind).reshape(len(part), -1)
            for left, right in _cells(part):
                other = left if right is None else right
                if not len(left) or not len(other):
                    continue
                i, j = np.nonzero(x[left] @ x[other].T >= threshold - 1e-9)
                i, j = left[i], other[j]
                if right is None:
                    i, j = i[i < j], j[i < j]
                # Products of matrices may round in another order than the definition does.
                exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
                i, j = i[exact], j[exact]
                fresh = first_tables(sig, i, j) == table[own[left[0]]] if len(i) else np.zeros(0, bool)
                found.append((own[i[fresh]], own[j[fresh]]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        links = np.bincount(i, copies[j], len(df)) + np.bincount(j, copies[i], len(df))
        root = least_rows(len(df), i, j)
        got = np.flatnonzero(links)
        return pd.DataFrame({"cls": df["cls"].to_numpy()[got], "rep": rep[got], "links": links[got].astype(np.int64), "other": rep[root[got]]})

    exact = left_open.join(groups.select("cls", "rep", "copies", "v"), "cls").join(stored.select("cls", "sig"), "cls")
    found = materialize(exact.groupBy(call).applyInPandas(linked, "cls bigint, rep bigint, links bigint, other bigint"), "vector-links")
    # An id with several vectors is one node, which connects their classes.
    several = usable.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("id")
    bridges = usable.join(several, "id").join(groups.select("key", "rep"), "key").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(bridges)).withColumnRenamed("node", "rep")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    told = groups.select("key", "cls", "rep", "copies").join(counts, "cls", "left").join(joined, "rep", "left")
    told = told.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "key").join(told, "key", "left")
    for done in (left_open, stored):
        discard(done)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
