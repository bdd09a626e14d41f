"""The corpus pipeline: five stages over ``documents``, each handing a Parquet table to the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from circuitlens.llm import bpe, mixing, quality_rules, secrets, simhash
from circuitlens.llm.common import read
from circuitlens.sources import shared


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and so do lines above the limits; ``n_chars`` is counted anew.

    Null texts are rejected; repeated rows share their verdict; other columns
    stay, whatever their names; an empty table gives an empty one.
    """
    return _sized(quality_rules.apply_rules(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of near copies (five-word shingles, similarity 0.8) stays.

    Rows that are equal in all columns are one; null ids come last, null and
    empty texts are copies of each other; see ``simhash.deduplicate``.
    """
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: all documents stay, with their secrets hidden; ``n_chars`` is counted anew. Null texts stay null."""
    return _sized(secrets.redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the documents that are drawn stay, with all columns; repeated rows stay or go together."""
    return mixing.sample(docs, mixing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids of every document, and a digest of the bytes that they decode to; null texts have none."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks, keep=True)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.col("ids").alias("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL expresses neither the fingerprints nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result but the last is a Parquet table in the shared folder.

    A table is deleted when the next one is written. The last one stays, as
    the result reads it whenever it is computed.
    """
    docs, folder = read(spark, sf_dir, "documents"), shared.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            shared.delete(spark, f"{folder}/{k - 1}")
    return docs
