"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept and returns the columns of documents, the last one tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, langid, linededup, minhash
from cadenza.llm.common import materialize, read_table
from cadenza.llm.queries import vocabulary

#: Executors come to the last stage with the memory of the others: slices and caches are smaller than those of the
#: operator alone.
SLICE_BYTES = 1_000_000
CACHE_WORDS = 60_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter (``und``) go."""
    return langid.with_language(docs, langid.train(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that occur earlier in the corpus; a text of which nothing is left goes."""
    return linededup.without_repeated_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    leaked = found.where("contaminated").select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, F.col("doc_id") == F.col("_leaked"), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), slice_bytes=SLICE_BYTES, cache_words=CACHE_WORDS)


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", unique_documents),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokenize),
]

#: Language ID and MinHash cannot be written in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
