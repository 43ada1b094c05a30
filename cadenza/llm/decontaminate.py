"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased.  At each word a fixed mask picks some of the next words and
ignores the others; the hash of the picked words is a seed.  Seeds of documents are joined to seeds of benchmark items,
so a passage is found although words at ignored places were replaced.  Around each hit the aligned words (``margin``
before and after the seed, as far as item and document go) are compared.  The hit counts if at least ``share`` of them
are equal, or ``RUN`` of them in a row, which is a stretch of a longer item.  Items shorter than a mask are sought whole.

Every hit is verified, whichever way the seeds are joined: the benchmark side is broadcast if a count of its seeds proves
it small, otherwise both sides are shuffled by seed and the texts are joined again for the comparison.  Beforehand, a
bitmap of fixed size tells where a document may have a seed at all.  Results are gathered for each document only.

Defined cases: null text has no words; items without words match nothing; repeated rows of one doc_id get the result of
all of them; null doc_id rows are returned as not contaminated; an empty table gives an empty result, an empty
benchmark finds nothing; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import BROADCAST_ROWS

#: 1: the word counts; 0: it is ignored.
MASKS = ("110110110110", "111010110111")
MARGIN = 8
SHARE = 0.75
#: Equal words in a row that suffice.
RUN = 13
#: Bits of the map of word pairs that seeds begin with.
BITMAP = 1 << 20


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _places(n: Column, span: int) -> Column:
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _pair(hashes: Column, i: Column) -> Column:
    return F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))


def pair_bitmap(seeds: DataFrame) -> list[int]:
    """Words of 64 bits, ``BITMAP`` bits in all, set for the first two words of the seeds of (other, other_at).

    What reaches the driver is at most the map, whatever the benchmark's size.
    """
    place = F.pmod(_pair(F.col("other"), F.col("other_at")), F.lit(BITMAP))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    found = seeds.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect()
    out = [0] * (BITMAP // 64)
    for r in found:
        out[r["word"]] = r["bits"]
    return out


def seeds_of(hashes: Column, masks: tuple[str, ...], lengths: tuple[int, ...], whole: bool = False, bitmap: list[int] | None = None) -> Column:
    """Structs (at, seed) of every mask, and of all runs of each of ``lengths`` words (``whole``: whole texts only).

    ``bitmap`` (see :func:`pair_bitmap`): seeds are formed only where it has the next two words, which loses none, since
    every mask of two words and more begins with two words that count.
    """
    known = F.lit(bitmap).cast("array<bigint>") if bitmap is not None else None

    def maybe(i: Column) -> Column:
        place = F.pmod(_pair(hashes, i), F.lit(BITMAP))
        return F.getbit(F.get(known, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1

    n = F.size(hashes)

    def hashed(k: int, picked: list[int]) -> Callable[[Column], Column]:
        # The number of the mask goes into the hash: seeds of different masks never meet.
        return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *(F.get(hashes, i + p) for p in picked)).alias("seed"))

    parts = []
    for k, mask in enumerate((*masks, *("1" * x for x in lengths))):
        places = F.when(n == len(mask), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")) if whole and k >= len(masks) else _places(n, len(mask))
        if known is not None and mask.startswith("11"):
            places = F.filter(places, maybe)
        parts.append(F.transform(places, hashed(k, [i for i, c in enumerate(mask) if c == "1"])))
    return F.concat(*parts)


def _agreement(own: Column, other: Column, at: Column, other_at: Column, width: Column) -> Column:
    """Struct (equal, compared, run) of the aligned words from MARGIN before the seed to MARGIN after it."""
    first = -F.least(at, other_at, F.lit(MARGIN))
    last = F.least(F.size(own) - at, F.size(other) - other_at, width + MARGIN) - 1
    same = F.transform(F.sequence(first, last), lambda d: F.when(F.get(own, at + d) == F.get(other, other_at + d), "1").otherwise("0"))
    marks = F.array_join(same, "")
    return F.struct(F.length(F.replace(marks, F.lit("0"), F.lit(""))).alias("equal"), (last - first + 1).alias("compared"), F.contains(marks, F.lit("1" * RUN)).alias("run"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, share: float = SHARE) -> DataFrame:
    """``id_col``, contaminated, n_items, item_ids (distinct, sorted, joined by commas) and best_share of every row."""
    span = max(map(len, masks))
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col).cast("string")).alias("other")).where(F.size("other") > 0)
    # At most span - 1 numbers, however large the benchmark.
    lengths = tuple(sorted(r[0] for r in items.where(F.size("other") < span).select(F.size("other")).distinct().collect()))
    seeds = items.select("item", "other", F.explode(seeds_of(F.col("other"), masks, lengths, whole=True)).alias("s")).select("item", "other", F.col("s.at").alias("other_at"), "s.seed")
    # Counted before anything is broadcast.
    small = seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    bitmap = pair_bitmap(seeds.where(F.size("other") > 1))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = narrow.where("id IS NOT NULL").select("id", word_hashes(F.col("text")).alias("own"))
    placed = hashed.select("id", "own", F.explode(seeds_of(F.col("own"), masks, lengths, bitmap=bitmap)).alias("d")).select("id", "own", F.col("d.at").alias("at"), F.col("d.seed").alias("dseed"))
    width = F.least(F.lit(span), F.size("other"))
    if small:
        hits = placed.join(F.broadcast(seeds), F.col("dseed") == F.col("seed"))
    else:
        met = placed.drop("own").join(seeds.drop("other"), F.col("dseed") == F.col("seed"))
        # One row for each diagonal of a document and an item carries the texts; every hit on it is verified.
        met = met.groupBy("id", "item", (F.col("at") - F.col("other_at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
        met = met.join(items, "item")
        met = met.join(hashed.withColumnRenamed("id", "hid"), F.col("id") == F.col("hid"))
        hits = met.withColumn("at", F.explode("ats")).withColumn("other_at", F.col("at") - F.col("diagonal"))
    judged = hits.select("id", "item", _agreement(F.col("own"), F.col("other"), F.col("at"), F.col("other_at"), width).alias("a"), width.alias("width"))
    sure = judged.where(((F.col("a.equal") >= share * F.col("a.compared")) & (F.col("a.compared") >= F.col("width"))) | F.col("a.run"))
    per_item = sure.groupBy("id", "item").agg(F.max(F.col("a.equal") / F.col("a.compared")).alias("best"))
    found = per_item.groupBy("id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("item_ids"), F.max("best").alias("best_share"))
    joined = narrow.select("id").join(found.withColumnRenamed("id", "fid"), F.col("id") == F.col("fid"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("best_share", F.lit(0.0)).alias("best_share"),
    )


def oracle() -> str:
    """DuckDB SQL of ``op7``: the same masks over words themselves, no hashes, no prefilter."""
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    span = max(map(len, MASKS))
    picked = lambda mask, w, i: "concat_ws(' ', " + ", ".join(f"{w}[{i} + {k + 1}]" for k, c in enumerate(mask) if c == "1") + ")"
    item = " UNION ALL ".join(f"SELECT item_id, {k} AS mask, unnest(range(0, len(o) - {len(m) - 1})) AS b, {len(m)} AS width, o FROM items WHERE len(o) >= {len(m)}" for k, m in enumerate(MASKS))
    doc = " UNION ALL ".join(f"SELECT doc_id, {k} AS mask, unnest(range(0, len(w) - {len(m) - 1})) AS a, w FROM words WHERE len(w) >= {len(m)}" for k, m in enumerate(MASKS))
    key = lambda w, i: "CASE mask " + " ".join(f"WHEN {k} THEN {picked(m, w, i)}" for k, m in enumerate(MASKS)) + " END"
    return f"""
WITH words AS (SELECT doc_id, {words("text")} AS w FROM documents),
items AS (SELECT item_id, {words("text")} AS o FROM benchmark),
si AS (SELECT *, {key("o", "b")} AS seed FROM ({item})),
sd AS (SELECT *, {key("w", "a")} AS seed FROM ({doc})),
short AS (SELECT item_id, o, array_to_string(o, ' ') AS seed, len(o) AS n FROM items WHERE len(o) BETWEEN 1 AND {span - 1}),
sl AS (SELECT DISTINCT n FROM short),
sw AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS a FROM words, sl WHERE len(w) >= n),
hits AS (
  SELECT doc_id, item_id, w, o, a, b, width FROM sd JOIN si USING (mask, seed)
  UNION ALL SELECT doc_id, item_id, w, o, a, 0, short.n FROM sw JOIN short ON sw.n = short.n AND array_to_string(w[a + 1 : a + sw.n], ' ') = seed
), lined AS (
  SELECT *, -least(a, b, {MARGIN}) AS lo, least(len(w) - a, len(o) - b, width + {MARGIN}) - 1 AS hi FROM hits
), judged AS (
  SELECT *, hi - lo + 1 AS n, array_to_string(list_transform(range(lo, hi + 1), lambda d: CASE WHEN w[a + d + 1] = o[b + d + 1] THEN '1' ELSE '0' END), '') AS marks FROM lined
), sure AS (
  SELECT doc_id, item_id, max(len(replace(marks, '0', '')) / n) AS best FROM judged WHERE (len(replace(marks, '0', '')) >= {SHARE} * n AND n >= width) OR contains(marks, '{"1" * RUN}') GROUP BY doc_id, item_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(best) AS best FROM sure GROUP BY doc_id
)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, CAST(coalesce(best, 0) AS DOUBLE) AS best_share FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
