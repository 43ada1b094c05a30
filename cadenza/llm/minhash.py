"""MinHash near-dedup with b-bit signatures.

A document is the set of its distinct five-word shingles, as 64-bit hashes.  ``HASHES`` minima are taken under
independent hash functions.  Bands of ``ROWS`` whole minima generate candidates; of each minimum only the low ``BITS``
bits are kept and packed, and the similarity of two documents is estimated from the number of equal low-bit groups,
corrected for chance collisions.  Pairs whose estimate is ``SIGMAS`` standard deviations below the threshold are not
followed up; all others are confirmed on the full shingle sets.

Documents with equal sets form a class, and only its first document goes on.  Candidates form groups (connected by
estimates): pairs of a bucket meet within blocks of ``BLOCK`` documents first, which connects most of a large bucket;
then, in buckets of several blocks, members of different groups meet across all blocks, pair of blocks by pair of blocks,
so that no pair of a bucket is left out whose members are not connected anyway.  A group's sets are brought together in blocks of ``BLOCK`` documents, each with the same ``LEADERS`` of the
group, so work and memory of a task are bounded however large a group is.  Within a block, exact comparison goes on
until every candidate pair is linked, connected through other links, or refuted.  In groups of several blocks that have
not become one component, members of different parts then meet across blocks, pair of blocks by pair of blocks.

Defined cases: null and empty texts have no shingles and link with nothing; fewer than five words make one shingle;
rows that repeat a doc_id are one node with the links of all of them, and each gets its own n_shingles; null doc_id
rows are returned unlinked; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import broadcast_if_small, give_back, materialize, tidy
from cadenza.llm.graph import components, least_rows

WORDS = 5
THRESHOLD = 75  # per cent
BANDS = 40
ROWS = 6
HASHES = BANDS * ROWS
BITS = 4
SIGMAS = 4.0
BLOCK = 192
LEADERS = 8
#: Ways of dealing the members of large buckets into blocks; with each, blocks of the ways before become connected.
WAYS = 3
#: Blocks of BLOCK documents that make up one side of a unit where members of different groups meet.
SIDE = 4
CACHE_WORDS = 100_000
#: Rows of buckets that are compared in one call, on average.
ROWS_PER_CALL = 600

_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = x = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = _SPLIT.findall(text.translate(_LOWER)) if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, HASHES) minima of non-empty sets, of linear permutations of the hashes' upper 32 bits."""
    out = np.empty((len(sets), HASHES), np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """Low BITS of each minimum, two to a byte."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << BITS)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a packed signature to others."""
    differ = one ^ others
    equal = ((differ & 0x0F) == 0).sum(axis=-1) + ((differ & 0xF0) == 0).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def least_estimate() -> float:
    """Estimate below which a pair at the threshold falls by SIGMAS standard deviations."""
    j, chance = THRESHOLD / 100, 1 / (1 << BITS)
    p = j + (1 - j) * chance
    return j - SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted distinct arrays reach the threshold."""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)


def describe(docs: DataFrame) -> DataFrame:
    """From (id, text): n_shingles, key (digest of the set), bands and packed signature; the last three null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                if len(known) > CACHE_WORDS:
                    known.clear()
                sets, size, first = [], 0, at
                while at < len(ids) and size < 300_000:
                    sets.append(shingles(texts[at].as_py(), known))
                    size += len(sets[-1])
                    at += 1
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if full:
                    m = minima([sets[k] for k in full])
                    h = np.tile(salt, (len(full), 1))
                    for r in range(ROWS):
                        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + m[:, r::ROWS][:, :BANDS].astype(np.uint64))
                    h, sig = h.view(np.int64), packed(m)
                    for n, k in enumerate(full):
                        keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        bands[k], sigs[k] = h[n], sig[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["id", "n_shingles", "key", "bands", "sig"],
                )

    return docs.mapInArrow(tidy(run), "id bigint, n_shingles bigint, key binary, bands array<bigint>, sig binary")


class Merged:
    """Components of row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


def confirmed(sets: list[np.ndarray], sigs: np.ndarray) -> np.ndarray:
    """Root row of each row after comparing, exactly, all pairs of sufficient estimate that are not connected yet."""
    merged = Merged(len(sets))
    least = least_estimate()
    for i in range(len(sets) - 1):
        near = np.flatnonzero(estimates(sigs[i], sigs[i + 1 :]) >= least) + i + 1
        for j in near.tolist():
            if merged.find(i) != merged.find(j) and similar(sets[i], sets[j]):
                merged.join(i, j)
    return merged.roots()


def _buckets(reps: DataFrame) -> DataFrame:
    """Rows (rep, bucket, way, size, blocks) of the band buckets that hold several representatives.

    ``way``: which of ``WAYS`` dealings into blocks the band uses.  ``blocks`` is a power of two, so bands that hold
    much the same documents deal them out alike, and their spanning forests are much the same edges.
    """
    spots = reps.select("rep", F.posexplode("bands").alias("way", "bucket")).withColumn("way", F.col("way") % WAYS)
    sizes = spots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(F.col("size") / BLOCK)))).cast("int")
    return spots.join(sizes, "bucket").withColumn("blocks", blocks)


def _grouped(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (rep, g): g is the least member of the group that pairs of a bucket with a sufficient estimate connect."""
    found = components(_within_blocks(buckets, reps)).select(F.col("node").alias("rep"), F.col("component").alias("g"))
    large = buckets.where("blocks > 1").select("rep", "bucket")
    if not large.limit(1).count():
        return found
    found = materialize(found, "minhash-parts-of-blocks")
    placed = large.join(found, "rep", "left").select("rep", "bucket", F.coalesce("g", "rep").alias("part"))
    # From here on a group is one node, so edges are few.
    merged = components(_between_groups(materialize(placed, "minhash-large"), reps)).withColumnRenamed("node", "part")
    every = found.union(merged.select("part", "part")).distinct()
    return every.join(merged, F.col("g") == F.col("part"), "left").select("rep", F.coalesce("component", "g").alias("g"))


def _units(spots: DataFrame, key: str, side: int) -> DataFrame:
    """Rows (rep, part, key, x, y, right): the members of ``key`` in units where those of different parts meet.

    Members of a key's largest part, and all others, are cut into blocks of ``side``.  A unit (x, y) holds two blocks, of
    which one at least is of the others; every pair of such blocks is a unit.  ``right`` tells its blocks apart.
    """
    shares = spots.groupBy(key, "part").agg(F.count("*").alias("n"))
    most = shares.groupBy(key).agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("n_rest"), F.max("n").alias("n_main")).where("n_rest > 0")
    most = most.select(key, "main", F.ceil(F.col("n_main") / side).cast("int").alias("mains"), F.ceil(F.col("n_rest") / side).cast("int").alias("rests"))
    rows = spots.join(most, key).withColumn("in_main", F.col("part") == F.col("main"))
    own = F.pmod(F.xxhash64("rep", key), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("own", own)
    rests = F.sequence(F.lit(0), F.col("rests") - 1)

    def unit(x, y, right):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), right.alias("right"))

    # x counts blocks of the largest part from 0 on, and blocks of the others from -1 down.
    of_main = F.transform(rests, lambda j: unit(F.col("own"), j, F.lit(False)))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: unit(m, F.col("own"), F.lit(True))),
        F.transform(rests, lambda j: unit(-1 - F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.col("own") > j)),
    )
    rows = rows.select("rep", "part", key, F.explode(F.when(F.col("in_main"), of_main).otherwise(of_rest)).alias("u"))
    return rows.select("rep", "part", key, "u.x", "u.y", "u.right")


def _near_in_unit(df: pd.DataFrame, sigs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, rows near k) for the rows of one block of a unit: those of the other block (one block with itself: rows after
    k) that are in another part and whose estimate is sufficient.  ``df`` is sorted by right."""
    part, least, n_left = df["part"].to_numpy(), least_estimate(), int((~df["right"].to_numpy(bool)).sum())
    whole = df["x"].iloc[0] < 0 and -1 - df["x"].iloc[0] == df["y"].iloc[0]  # one block with itself
    for k in range(n_left):
        first = k + 1 if whole else n_left
        yield k, np.flatnonzero((part[first:] != part[k]) & (estimates(sigs[k], sigs[first:]) >= least)) + first


def _between_groups(spots: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) of the parts of a bucket that hold a pair with a sufficient estimate: a forest for each unit."""
    rows = _units(spots, "bucket", SIDE * BLOCK).join(reps.select("rep", "sig"), "rep")

    def forest(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["right", "rep"])
        part = df["part"].to_numpy()
        sigs = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(len(part), -1)
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, near in _near_in_unit(df, sigs):
            i.append(np.full(len(near), k))
            j.append(near)
        parts, of = np.unique(part, return_inverse=True)
        root = least_rows(len(parts), of[np.concatenate(i)], of[np.concatenate(j)])
        own = np.flatnonzero(root != np.arange(len(parts)))
        return pd.DataFrame({"a": parts[own], "b": parts[root[own]]})

    found = rows.groupBy("bucket", "x", "y").applyInPandas(forest, "a bigint, b bigint")
    return materialize(found.distinct(), "minhash-between")


def _within_blocks(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b): a spanning forest, in each block of each bucket, of the pairs with a sufficient estimate.

    The block of a document differs between the ways of dealing, so large buckets that share their members mix.
    """
    block = F.pmod(F.xxhash64("rep", "way"), "blocks")
    rows = buckets.select("rep", F.xxhash64("bucket", block).alias("cell")).join(reps.select("rep", "sig"), "rep")
    # Most cells hold two or three rows: many of them make up one call.
    calls = max(1, buckets.count() // ROWS_PER_CALL)

    def forest(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["cell", "rep"])
        rep, cell = df["rep"].to_numpy(), df["cell"].to_numpy()
        sigs = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(len(rep), -1)
        least, found = least_estimate(), []
        ends = np.searchsorted(cell, cell, side="right")
        for i, j in _pairs(ends):
            near = estimates(sigs[i], sigs[j]) >= least
            found.append((i[near], j[near]))
        i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        root = least_rows(len(rep), i, j)
        own = np.flatnonzero(root != np.arange(len(rep)))
        give_back()
        return pd.DataFrame({"a": rep[own], "b": rep[root[own]]})

    found = rows.groupBy(F.pmod("cell", F.lit(calls)).alias("call")).applyInPandas(forest, "a bigint, b bigint")
    return materialize(found.distinct(), "minhash-candidates")


def _pairs(ends: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], some 100,000 at a time."""
    counts = ends - np.arange(len(ends)) - 1
    total = np.cumsum(counts)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        n = counts[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        first = np.cumsum(n) - n
        yield i, i + 1 + np.arange(len(i)) - np.repeat(first, n)
        at = stop


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns of ``wanted`` (id, key and others) with the shingle set (hashes as bytes) and signature of each class."""
    wanted = broadcast_if_small(wanted)
    rows = texts.join(wanted.withColumnRenamed("id", "wid"), F.col("id") == F.col("wid")).drop("wid")
    others = [c for c in rows.columns if c not in ("text",)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            if len(known) > CACHE_WORDS:
                known.clear()
            sets = [shingles(t, known).tobytes() for t in batch.column("text").to_pylist()]
            # A repeated id has other texts, whose sets are not those of this class.
            fits = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sets, pa.binary())], names=[*others, "shingles"])
            yield out.filter(pa.array(fits))

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others), "shingles binary"])
    return rows.mapInArrow(tidy(run), schema)


def _links(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed edges (a, b) that connect whatever confirmed pairs connect."""
    buckets = materialize(_buckets(reps), "minhash-buckets")
    grouped = _grouped(buckets, reps)
    sizes = grouped.groupBy("g").agg(F.count("*").alias("size"))
    members = grouped.join(sizes, "g").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    leader = (F.col("blocks") > 1) & ((F.col("rep") == F.col("g")) | (F.pmod(F.xxhash64("rep", "size"), "size") < LEADERS))
    where = F.when(leader, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    members = materialize(members.join(reps.select("rep", "key"), "rep").select(F.col("rep").alias("id"), "key", "g", "blocks", where.alias("where")), "minhash-groups")
    rows = _sets(texts, members).join(reps.select(F.col("rep").alias("id"), "sig"), "id").select("id", "g", "shingles", "sig", F.explode("where").alias("block"))

    def confirm(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates("id").sort_values("id")
        ids = df["id"].to_numpy()
        sigs = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(len(ids), -1)
        root = confirmed([np.frombuffer(s, np.uint64) for s in df["shingles"]], sigs)
        own = np.flatnonzero(root != np.arange(len(ids)))
        if len(ids) > BLOCK // 2:
            give_back()
        return pd.DataFrame({"a": ids[own], "b": ids[root[own]]})

    links = materialize(rows.groupBy("g", "block").applyInPandas(confirm, "a bigint, b bigint"), "minhash-links")
    large = members.where("blocks > 1").select(F.col("id").alias("rep"), "g")
    if not large.limit(1).count():
        return links
    return _across(links, large, reps, texts)


def _across(links: DataFrame, large: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """``links`` and the confirmed edges between parts of large groups that have remained apart.

    In each such group, members outside its largest part meet all others in units of two blocks, with their sets.  Where
    the estimate suffices, pairs are confirmed at once, until their parts are linked: rows are those of the members of
    units, never of pairs.  Where a group has become one part, nothing is left to do.
    """
    parts = components(links).withColumnRenamed("node", "n")
    placed = large.join(parts, F.col("rep") == F.col("n"), "left").select("rep", "g", F.coalesce("component", "rep").alias("part"))
    open_groups = placed.groupBy("g").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("g")
    placed = materialize(placed.join(open_groups, "g", "left_semi").select("rep", "g", "part"), "minhash-parts")
    if not placed.limit(1).count():
        return links
    sets = _sets(texts, placed.select(F.col("rep").alias("id")).join(reps.select(F.col("rep").alias("id"), "key", "sig"), "id"))
    sets = materialize(sets.select(F.col("id").alias("rep"), "sig", "shingles").dropDuplicates(["rep"]), "minhash-sets")
    rows = _units(placed, "g", max(1, BLOCK // 2)).join(sets, "rep")

    def confirm(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["right", "rep"])
        rep = df["rep"].to_numpy()
        sigs = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(len(rep), -1)
        sets = [np.frombuffer(s, np.uint64) for s in df["shingles"]]
        parts, of = np.unique(df["part"].to_numpy(), return_inverse=True)
        merged, found = Merged(len(parts)), []
        for k, near in _near_in_unit(df, sigs):
            for n in near.tolist():
                if merged.find(of[k]) != merged.find(of[n]) and similar(sets[k], sets[n]):
                    merged.join(of[k], of[n])
                    found.append((rep[k], rep[n]))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    late = rows.groupBy("g", "x", "y").applyInPandas(confirm, "a bigint, b bigint")
    return links.unionByName(materialize(late, "minhash-late-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id and kept of every row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(describe(texts), "minhash")
    usable = described.where("key IS NOT NULL AND id IS NOT NULL")
    groups = materialize(usable.groupBy("key").agg(F.min("id").alias("rep")), "minhash-classes")
    # One row for each class; ids that repeat with other texts stand for all their classes.
    reps = usable.join(groups, "key").where("id = rep").select("rep", "key", "n_shingles", "bands", "sig").dropDuplicates(["key"])
    reps = materialize(reps, "minhash-reps")
    links = _links(reps, texts)
    copies = usable.join(groups, "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    joined = components(links.unionByName(copies)).withColumnRenamed("node", "nid")
    component = F.coalesce("component", "id")
    out = described.select("id", "n_shingles").join(joined, F.col("id") == F.col("nid"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
