"""Repeated-substring dedup with a run-length BWT index.

Every byte that lies in a ``LENGTH``-byte string which also starts elsewhere (in any document, the same one included) is
removed.  Work is dealt out by content: each window of ``LENGTH`` bytes is assigned to its leftmost minimiser, the
``GRAM``-byte string of least hash within it, so equal windows, wherever they are, have equal minimisers.  Consecutive
windows with one minimiser form a context; contexts of one document share fewer than ``LENGTH`` bytes, so no window is
in two of them.

Contexts are counted by minimiser with partial aggregation.  A minimiser that occurs once has no repeated window; if
all its contexts are equal, all their windows are repeated.  Otherwise one text of each distinct context is indexed
with the others of its bucket: the suffixes are sorted, the Burrows-Wheeler transform is cut into runs, and positions
are sampled at the runs' ends.  Only there are match lengths computed by comparison; between them the statistics are
streamed along the text, each one less than the one before.  Lengths of ``LENGTH`` and more mark windows.

A short passage in very many different surroundings gives its minimiser more distinct contexts than one index should
hold (``MANY``).  These contexts are dealt out once more, by minimisers of longer strings, and so on (``GRAMS``): what
surrounds the passage tells them apart, until at the last level, where the string is the window, all that have one
minimiser are equal.  Every level gives the same answer for the windows it gets, so ``MANY`` bounds a task and nothing
else.

Contexts are told apart by the hash of the minimiser and a digest of the whole, 128 bits in all.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` keep everything; a text in two rows is repeated,
whatever their ids; rows of null or equal ids are told apart and each gets its own removals; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, join_with_hot_keys, materialize, portions, tidy

LENGTH = 200
#: Lengths of the strings that minimisers are chosen from, one for each level.
GRAMS = (32, 96, 160, LENGTH)
#: Distinct contexts of one minimiser that are indexed together at most (some 1.2 MB of text, 140 MB of arrays), and
#: contexts of a bucket on average.
MANY = 4_000
BUCKET = 512
#: Bytes of text that a worker holds as Python strings and arrays at a time (some 80 bytes for each).
SLICE = 1 << 19

_PLACE = np.uint64((1 << 24) - 1)
_RNG = np.random.default_rng(11)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEPS = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 62, 1 << 63, 8, dtype=np.uint64)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes: of two overlapping strings of a power of two, which come by doubling."""
    h, width, k = _BYTES[data], 1, 0
    while 2 * width <= gram:
        h = h[:-width] * _STEPS[k] + h[width:]
        h ^= h >> np.uint64(29)
        width, k = 2 * width, k + 1
    if width < gram:
        h = h[: len(h) - (gram - width)] * _STEPS[6] + h[gram - width :]
        h ^= h >> np.uint64(31)
    h = h * _STEPS[7]
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def contexts(data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and last window of each context; fewer than 2**24 bytes."""
    h = gram_hashes(data, gram)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keyed, LENGTH - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]].view(np.int64), first, last


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of concatenated strings in order; ``ends``: where each string ends.  Strings end in distinct marks."""
    n = len(data)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    left = ends[owner] - np.arange(n)
    width = 7
    key = np.zeros(n, np.int64)
    for t in range(width):
        value = np.zeros(n, np.int64)
        value[: max(0, n - t)] = data[t:].astype(np.int64) + 1
        value[left <= t] = 0
        key = (key << 9) | value
    marks = len(ends)
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank[order[-1]] == n - 1 or width > 4 * int(left.max(initial=1)):
            return order
        beyond = owner.copy()  # strings that end here differ by their marks
        more = np.flatnonzero(left > width)
        beyond[more] = rank[more + width] + marks
        key = rank * (n + marks) + beyond
        width *= 2


def match_lengths(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest string from there that also starts elsewhere, strings kept apart.

    The runs of the Burrows-Wheeler transform give the places where a length must be found by comparison.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    order = suffix_order(data, ends)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    left = ends[owner] - np.arange(n)
    starts = ends - np.diff(ends, prepend=0)
    before = np.empty(n, np.int64)
    before[1:] = data[:-1]
    before[starts[starts < n]] = 256 + np.arange(len(starts))[starts < n]
    bwt = before[order]
    cut = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # first rows of runs but for row 0
    top, bottom = order[cut - 1], order[cut]  # sampled: last suffix of a run, first of the next
    agreed = _agreement(data, top, bottom, np.minimum(left[top], left[bottom]))
    best = np.zeros(n, np.int64)
    for place, other_end in ((bottom, order[0]), (top, order[-1])):
        sampled = np.full(n, -1, np.int64)
        sampled[place] = agreed
        sampled[other_end] = 0  # it has no neighbour on this side
        known = np.flatnonzero(sampled >= 0)
        near = known[np.searchsorted(known, np.arange(n), side="right") - 1]
        # The first place starts a string, so its row is a run of its own: known[0] is 0.
        best = np.maximum(best, sampled[near] - (np.arange(n) - near))
    return np.minimum(best, left)


def _agreement(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 16
    padded = np.concatenate([data, np.zeros(step, np.uint8)])
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = padded[x[:, None] + np.arange(step)] != padded[y[:, None] + np.arange(step)]
        found = differ.any(axis=1)
        out[live] += np.where(found, differ.argmax(axis=1), step)
        live = live[~found & (out[live] < most[live])]
    return np.minimum(out, most)


def _pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of byte strings: bytes, number of each string in it, and where each begins (one more at the end).

    Longer strings come in pieces that share LENGTH - 1 bytes, so each window is in one piece; the third array then holds
    the offset of the piece within its string as an extra item.
    """
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        if len(raw) > 8 * SLICE:
            for at in range(0, len(raw) - LENGTH + 1, 8 * SLICE):
                piece = raw[at : at + 8 * SLICE + LENGTH - 1]
                yield np.frombuffer(piece, np.uint8), np.array([k]), np.array([0, len(piece), at])
            continue
        rows.append(k)
        parts.append(raw)
        size += len(raw)
        if size >= SLICE:
            yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.cumsum([0, *map(len, parts), -size])
            rows, parts, size = [], [], 0
    if rows:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.cumsum([0, *map(len, parts), -size])


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _cut(raws: list[bytes], gram: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Contexts of byte strings: minimiser, digest, number of the string, first window, number of windows, text."""
    for data, rows, bounds in _pieces(raws):
        begins, shift = bounds[:-1], int(bounds[-1])
        h, first, last = contexts(data, gram)
        # Cut at the ends of strings: windows that reach into the next one are none.
        text = np.searchsorted(begins, first, side="right") - 1
        text_end = np.searchsorted(begins, last, side="right") - 1
        spill = np.flatnonzero(text_end > text)
        if len(spill):
            more = [(h[k], begins[t], last[k] if t == text_end[k] else begins[t + 1] - 1, t) for k in spill.tolist() for t in range(text[k] + 1, text_end[k] + 1)]
            last[spill] = begins[text[spill] + 1] - 1
            h = np.concatenate([h, np.array([m[0] for m in more], np.int64)])
            first, last, text = (np.concatenate([x, np.array([m[i] for m in more], np.int64)]) for x, i in ((first, 1), (last, 2), (text, 3)))
        last = np.minimum(last, begins[text + 1] - LENGTH)
        good = np.flatnonzero(last >= first)
        h, first, last, text = h[good], first[good], last[good], text[good]
        raw = data.tobytes()
        bodies = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        yield h, [_digest(x) for x in bodies], rows[text], first - begins[text] + shift, last - first + 1, bodies


def _placed(texts: DataFrame) -> DataFrame:
    """Rows (h, c, id, at, n): minimiser, digest of the context, and its first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, 1, SLICE)):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for h, c, rows, at, n, _ in _cut(raws, GRAMS[0]):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.int64()), batch.column(0).take(pa.array(rows)), pa.array(at, pa.int64()), pa.array(n.astype(np.int32))], names=["h", "c", "id", "at", "n"])

    return texts.mapInArrow(tidy(run), "h bigint, c bigint, id bigint, at bigint, n int")


def _dealt_again(bodies: DataFrame, gram: int) -> DataFrame:
    """Contexts (h, c, copies, body, ph, pc, at) of bodies (h, c, copies, body) by longer strings, with their origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, b.schema.get_field_index("body"), SLICE)):
            raws = batch.column("body").to_pylist()
            for h, c, rows, at, _, parts in _cut(raws, gram):
                origin = [batch.column(x).take(pa.array(rows)) for x in ("copies", "h", "c")]
                # The minimiser's own hash joins that of the level before, which all that are equal share.
                mixed = (h.view(np.uint64) * _STEPS[5] ^ origin[1].to_numpy().view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mixed), pa.array(c, pa.int64()), origin[0], pa.array(parts, pa.binary()), origin[1], origin[2], pa.array(at, pa.int32())], names=["h", "c", "copies", "body", "ph", "pc", "at"])

    return bodies.mapInArrow(tidy(run), "h bigint, c bigint, copies bigint, body binary, ph bigint, pc bigint, at int")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (h, c, copies, body) of the contexts in ``wanted`` (h, c, copies, id, at, n)."""
    lists = wanted.groupBy(F.col("id").alias("wid")).agg(F.collect_list(F.struct("h", "c", "copies", "at", "n")).alias("wanted"))
    rows = texts.join(lists, F.col("id") == F.col("wid")).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, items in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                items = items.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in items], pa.int64()) for k in ("h", "c", "copies")] + [pa.array([raw[x["at"] : x["at"] + x["n"] - 1 + LENGTH] for x in items], pa.binary())],
                    names=["h", "c", "copies", "body"],
                )

    return rows.mapInArrow(tidy(run), "h bigint, c bigint, copies bigint, body binary")


def _repeated_ranges(flags: np.ndarray) -> list[int]:
    """Bounds (first, last + 1) of the runs of true values, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _indexed(df: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of the contexts of a bucket, as ranges of window numbers."""
    df = df.sort_values(["h", "c"])
    bodies = df["body"].tolist()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    long = match_lengths(data, ends) >= LENGTH
    ranges = []
    for copies, a, b in zip(df["copies"].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        ranges.append(_repeated_ranges(long[a : b - LENGTH + 1] if copies == 1 else np.ones(b - a - LENGTH + 1, bool)))
    return pd.DataFrame({"h": df["h"].to_numpy(), "c": df["c"].to_numpy(), "ranges": ranges})


def _ranges(bodies: DataFrame, level: int = 0) -> DataFrame:
    """Repeated windows (h, c, ranges) of distinct contexts (h, c, copies, body) whose minimiser has several."""
    sizes = bodies.groupBy("h").agg(F.count("*").alias("contexts"))
    many = sizes.where(F.col("contexts") > MANY).select("h")
    # Each holds more than MANY contexts, so they are few beside the contexts.
    many = materialize(many, "repeat-many")
    has_many = many.limit(1).count() > 0
    few = bodies.join(many, "h", "left_anti") if has_many else bodies
    buckets = max(1, -(-bodies.count() // BUCKET))
    found = few.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInPandas(_indexed, "h bigint, c bigint, ranges array<int>")
    if has_many:
        found = found.unionByName(_of_many(bodies.join(many, "h", "left_semi"), level + 1))
    return found.where("size(ranges) > 0")


def _of_many(bodies: DataFrame, level: int) -> DataFrame:
    """The same for minimisers with very many contexts, which are dealt out by longer strings."""
    placed = materialize(_dealt_again(bodies, GRAMS[level]), f"repeat-level-{level}")
    rows = placed.count()
    distinct = placed.groupBy("h", "c").agg(F.sum("copies").alias("copies"), F.count("*").alias("places"), F.any_value("body").alias("body"))
    distinct = materialize(distinct, f"repeat-distinct-{level}")
    if level + 1 < len(GRAMS):
        sizes = distinct.groupBy("h").agg(F.count("*").alias("contexts"), (F.count("*") > 1).alias("mixed"))
        distinct = join_with_hot_keys(distinct, sizes, ["h"], "contexts", rows)
    else:  # the minimiser is the window
        distinct = distinct.withColumn("mixed", F.lit(False))
    # Alone under its minimiser, a context is repeated as a whole or not at all.
    n = F.length("body") - LENGTH + 1
    whole = distinct.where("NOT mixed AND copies > 1").select("h", "c", "places", F.array(F.lit(0), n).alias("ranges"))
    mixed = distinct.where("mixed")
    if not mixed.limit(1).count():
        found = whole
    else:
        part = _ranges(mixed.select("h", "c", "copies", "body"), level)
        found = whole.unionByName(part.join(mixed.select("h", "c", "places"), ["h", "c"]).select("h", "c", "places", "ranges"))
    back = join_with_hot_keys(placed.select("h", "c", "ph", "pc", "at"), materialize(found, f"repeat-found-{level}"), ["h", "c"], "places", rows)
    moved = back.select("ph", "pc", F.transform("ranges", lambda x: F.col("at") + x).alias("ranges"))
    return moved.groupBy(F.col("ph").alias("h"), F.col("pc").alias("c")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) with a number of its own for each row, and the rows (id, given, text) that these numbers stand for."""
    rows = docs.select(F.col(id_col).alias("given"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["given"]
    odd = rows.groupBy("given").count().where("count > 1 OR given IS NULL")
    if kind not in ("tinyint", "smallint", "int", "bigint") or odd.limit(1).count():
        # Written once, so that the numbers stay.
        rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "repeat-rows")
    else:
        rows = rows.withColumn("id", F.col("given").cast("bigint"))
    return rows.select("id", "text"), rows


def _spans(texts: DataFrame) -> DataFrame:
    """Rows (id, starts, ends): byte ranges to remove, of the rows that have any; they may overlap."""
    placed = materialize(_placed(texts), "repeat-contexts")
    total = placed.count()
    kinds = placed.groupBy("h").agg(F.count("*").alias("total"), F.min("c").alias("low"), F.max("c").alias("high")).where("total > 1")
    kinds = materialize(kinds.select("h", (F.col("low") != F.col("high")).alias("mixed"), "total"), "repeat-kinds")
    shared = materialize(join_with_hot_keys(placed, kinds, ["h"], "total", total), "repeat-shared")
    discard(placed)
    mixed = shared.where("mixed")
    distinct = mixed.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("id", "at", "n")).alias("one")).select("h", "c", "copies", "one.*")
    bodies = materialize(_texts_of(texts, distinct), "repeat-bodies")
    found = materialize(_ranges(bodies).join(bodies.select("h", "c", "copies"), ["h", "c"]), "repeat-ranges")
    discard(bodies)
    whole = shared.where("NOT mixed").select("id", F.array(F.col("at")).alias("starts"), F.array(F.col("at") + F.col("n") - 1 + LENGTH).alias("ends"))
    part = join_with_hot_keys(mixed.select("h", "c", "id", "at"), found, ["h", "c"], "copies", total)
    even = F.filter("ranges", lambda x, k: k % 2 == 0)
    odd = F.filter("ranges", lambda x, k: k % 2 == 1)
    part = part.select("id", F.transform(even, lambda x: F.col("at") + x).alias("starts"), F.transform(odd, lambda x: F.col("at") + x - 1 + LENGTH).alias("ends"))
    spans = whole.unionByName(part).groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = materialize(spans, "repeat-spans")
    for done in (shared, kinds, found):
        discard(done)
    return spans


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, starts, ends): byte ranges to remove, one for each row that has any; ranges may overlap."""
    texts, rows = _keyed(docs, id_col, text_col)
    return rows.select("id", "given").join(_spans(texts), "id").select(F.col("given").alias(id_col), "starts", "ends")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("kept",)) -> DataFrame:
    """Every row's n_bytes, n_removed, n_spans and, as asked for in ``outputs``, kept (binary) and kept_sha256."""
    texts, rows = _keyed(docs, id_col, text_col)
    rows = rows.join(_spans(texts), "id", "left").select(F.col("given").alias("id"), "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, 1, SLICE)):
            made: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", *outputs)}
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in ("text", "starts", "ends")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, n_spans = [], 0, 0
                if starts:
                    order = np.argsort(np.array(starts), kind="stable")
                    s, e = np.array(starts)[order], np.maximum.accumulate(np.array(ends)[order])
                    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    for a, b in zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist(), strict=True):
                        kept.append(raw[at:a])
                        at, n_spans = b, n_spans + 1
                kept.append(raw[at:])
                rest = b"".join(kept)
                made["n_bytes"].append(len(raw))
                made["n_removed"].append(len(raw) - len(rest))
                made["n_spans"].append(n_spans)
                if "kept" in made:
                    made["kept"].append(rest)
                if "kept_sha256" in made:
                    made["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in made.items())], names=["id", *made])

    sql = {"kept": "binary", "kept_sha256": "string"}
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", "n_bytes bigint", "n_removed bigint", "n_spans bigint", *(f"{k} {sql[k]}" for k in outputs)])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
