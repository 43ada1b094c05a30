"""Line dedup by content-defined line chunks, with DataFrame functions only.

A rolling hash over the hashes of each line and the line before it ends a chunk wherever its remainder modulo
``divisor`` is 0, so inserting or deleting lines moves boundaries only nearby.  Chunks of two lines or more that occur
again, anywhere in the table, are removed except at their first place (least doc_id, then least chunk number).  Chunks
are paired by a 64-bit hash; only byte-equal ones are removed.

No step gathers the copies of a chunk in one place: hashes are counted with partial aggregation, copies meet their
first occurrence in an equi-join that Spark may split where a key is hot, and lists are kept for each document only.

Defined cases: null text stays null and has no lines; empty text is one empty line; rows with one doc_id and equal
texts are copies of each other, the first of which cannot be told, so all chunks of that doc_id stay where they are the
first; null doc_id rows are returned unchanged; an empty table gives an empty result; columns of any name may be
present, since only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, materialize

DIVISOR = 3


def line_hash(line: Column) -> Column:
    """First 31 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunk_ends(lines: Column, divisor: int = DIVISOR) -> Column:
    """Numbers (from 1) of the lines that end a chunk; the last line always does."""
    hashes = F.transform(lines, line_hash)
    # (previous, last line's hash) pairs by zipping the hashes with themselves, moved on by one.
    rolled = F.zip_with(hashes, F.concat(F.array(F.lit(0).cast("bigint")), hashes), lambda h, before: F.when(h.isNotNull(), (h * 31 + before) % divisor == 0))
    numbered = F.transform(rolled, lambda ends, i: F.when(ends | (i + 1 == F.size(lines)), i + 1))
    return F.filter(numbered, lambda n: n.isNotNull())


def chunks_of(ends: Column) -> Column:
    """Structs (start, n_lines), lines counted from 1."""
    return F.zip_with(F.concat(F.array(F.lit(0)), ends), ends, lambda a, b: F.when(b.isNotNull(), F.struct((a + 1).alias("start"), (b - a).alias("n_lines"))))


def _body(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"], chunk["n_lines"]), "\n")


def _cut(docs: DataFrame, divisor: int) -> DataFrame:
    """Adds lines and chunks (start, n_lines) to rows of id and text."""
    cut = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("ends", chunk_ends(F.col("lines"), divisor))
    return cut.withColumn("chunks", F.filter(chunks_of(F.col("ends")), lambda c: c.isNotNull())).drop("ends")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``id_col``, text (what is left), n_lines, n_removed (lines) and n_chunks_removed of every row."""
    return _deduped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), divisor).withColumnRenamed("id", id_col)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with what is left of each text, and ``n_chars``, if there is one, counted again where lines went.

    Rows of which nothing is left go.  The other columns travel with the text, so no further join is needed.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("rest"))
    done = _deduped(rows, divisor).where("n_removed = 0 OR text <> ''")

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").cast(docs.schema[c].dataType)
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("rest")[c])
        return F.col("rest")[c]

    return done.select(*(column(c).alias(c) for c in docs.columns))


def _deduped(rows: DataFrame, divisor: int) -> DataFrame:
    """Columns of ``rows`` (id, text and others), text being what is left of it, n_lines, n_removed, n_chunks_removed."""
    cut = _cut(rows, divisor)
    # posexplode, not transform over bodies: one body at a time is hashed and dropped.
    numbered = cut.where(F.col("id").isNotNull()).select("id", "lines", F.posexplode("chunks").alias("no", "chunk")).where("chunk.n_lines >= 2")
    index = materialize(numbered.select("id", (F.col("no") + 1).alias("no"), F.xxhash64(_body(F.col("lines"), F.col("chunk"))).alias("key")), "line-chunks")
    place = F.struct("id", "no")
    repeated = index.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(F.col("key").alias("rkey"), "first")
    marked = index.join(repeated, F.col("key") == F.col("rkey")).select("id", "no", "key", (place == F.col("first")).alias("is_first"))
    wanted = marked.groupBy("id").agg(F.collect_set(F.struct("no", "key", "is_first")).alias("wanted")).withColumnRenamed("id", "wid")
    bodies = cut.join(wanted, F.col("id") == F.col("wid")).select("id", "lines", "chunks", F.explode("wanted").alias("w"))
    bodies = materialize(bodies.select("id", "w.no", "w.key", "w.is_first", _body(F.col("lines"), F.get("chunks", F.col("w.no") - 1)).alias("body")), "line-bodies")
    firsts = bodies.where("is_first").select(F.col("key").alias("fkey"), F.col("body").alias("fbody"))
    equal = bodies.where("NOT is_first").join(firsts, (F.col("key") == F.col("fkey")) & (F.col("body") == F.col("fbody")), "left_semi")
    removed = materialize(equal.groupBy("id").agg(F.collect_set("no").alias("removed")).withColumnRenamed("id", "rid"), "line-removed")
    discard(index)
    discard(bodies)
    gone = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    kept = F.array_except(F.when(F.size("chunks") > 0, F.sequence(F.lit(1), F.size("chunks"))).otherwise(F.array().cast("array<int>")), gone)
    # Without a removal the text is passed on as it is.
    joined = cut.join(removed, F.col("id") == F.col("rid"), "left")
    rest = F.array_join(F.transform(kept, lambda k: _body(F.col("lines"), F.get("chunks", k - 1))), "\n")
    lost = F.aggregate(gone, F.lit(0).cast("bigint"), lambda n, k: n + F.get("chunks", k - 1)["n_lines"])
    return joined.select(
        *(F.col(c) for c in rows.columns if c != "text"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(rest).alias("text"),
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_lines"),
        lost.alias("n_removed"),
        F.size(gone).cast("bigint").alias("n_chunks_removed"),
    )


def oracle(divisor: int = DIVISOR) -> str:
    """DuckDB SQL of ``op2``: brute force over chunk texts."""
    return f"""
WITH lined AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), hashed AS (
  SELECT *, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM lined
), ended AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (h[i] * 31 + CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) % {divisor} = 0) AS ends FROM hashed
), chunked AS (
  SELECT doc_id, text, lines, unnest(range(1, len(ends) + 1)) AS no, ends FROM ended
), bodied AS (
  SELECT doc_id, no, ends[no] - CASE WHEN no > 1 THEN ends[no - 1] ELSE 0 END AS k,
    array_to_string(list_slice(lines, CASE WHEN no > 1 THEN ends[no - 1] ELSE 0 END + 1, ends[no]), chr(10)) AS body FROM chunked
), firsts AS (
  SELECT body, min(struct_pack(a := doc_id, b := no)) AS place FROM bodied WHERE k >= 2 GROUP BY body
), judged AS (
  SELECT b.*, b.k >= 2 AND f.place != struct_pack(a := b.doc_id, b := b.no) AS gone FROM bodied b LEFT JOIN firsts f ON b.body = f.body
), rest AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept,
    sum(CASE WHEN gone THEN k ELSE 0 END) AS n_removed, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_chunks_removed FROM judged GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.lines) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(r.n_chunks_removed, 0) AS BIGINT) AS n_chunks_removed,
  CASE WHEN l.text IS NOT NULL THEN sha256(coalesce(r.kept, '')) END AS kept_sha256
FROM lined l LEFT JOIN rest r ON l.doc_id = r.doc_id
"""
