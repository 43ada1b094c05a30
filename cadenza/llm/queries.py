"""Driver queries of the text operators: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, embeddings, langid, licenses, linededup, minhash, repeats, secrets, toxicity
from cadenza.llm.common import held_out, read_table


def vocabulary() -> tuple[bytes, str]:
    """Content of the default rank file, read on the driver, and its split pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), *vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read_table(spark, sf_dir, "documents"), outputs=("kept_sha256",))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cut")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words", "toxic_spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_repeats": op3_repeats,
        "op4_language_id": op4_language_id,
        "op5_secrets": op5_secrets,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_minhash_dedup": op10_minhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.oracle(), "op7_decontamination": decontaminate.oracle(), "op9_license_scan": licenses.oracle()}
