"""Thin queries over the operators of this subpackage: one ``opN_<name>`` each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmill.llm.bpe import encode_and_check
from runmill.llm.chat import OP2_SQL, format_preferences, swapped_ends
from runmill.llm.mixing import mix_rows
from runmill.llm.ngram_join import join_documents
from runmill.llm.quality import assess
from runmill.llm.secret_scan import scan_documents
from runmill.llm.sharding import shard_documents
from runmill.llm.sql import OP7_SQL, OP8_SQL, OP9_SQL, OP10_SQL
from runmill.llm.substring import remove_repeated
from runmill.llm.toxicity import learn, score_documents
from runmill.llm.vectors import link_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, decoded layers included."""
    return scan_documents(_table(spark, sf_dir, "documents"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen side, against its first half with the end of the next one."""
    return format_preferences(swapped_ends(_table(spark, sf_dir, "conversations")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    import public_tokenizers

    return encode_and_check(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix whose source weights are the square roots of the source sizes."""
    return mix_rows(_table(spark, sf_dir, "documents"), carry=["doc_id", "source"]).select(
        "doc_id",
        "source",
        F.col("_mix_block").alias("block"),
        F.col("_mix_release").alias("release"),
        F.col("_mix_deadline").alias("deadline"),
        F.col("_mix_slot").alias("slot"),
        F.col("_mix_position").alias("position"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of a 2 x 2 x 2 tree, and their shard when one more region joins."""
    return shard_documents(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the least id of its component."""
    return join_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    return remove_repeated(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return assess(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors, within their labels."""
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_preferences, op3_bpe, op4_mixing, op5_sharding, op6_toxicity, op7_ngram_join, op8_substrings, op9_quality, op10_vectors)}


def oracle_sql() -> dict[str, str]:
    return {"op2_preferences": OP2_SQL, "op7_ngram_join": OP7_SQL, "op8_substrings": OP8_SQL, "op9_quality": OP9_SQL, "op10_vectors": OP10_SQL}
