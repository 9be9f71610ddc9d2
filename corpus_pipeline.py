"""Corpus pipeline over ``documents``: toxicity, near duplicates, benchmark passages, personal data, tokens.

Each stage works on all rows its predecessor kept; each but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encoded
from tessera.llm.common import free_name, read, written
from tessera.llm.decontamination import decontaminated
from tessera.llm.pii import scrubbed
from tessera.llm.simhash import keep_one
from tessera.llm.toxicity import without_toxic

SHINGLE, BITS = 3, 3  # words of a shingle and most differing bits of near duplicates


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from ``labels``, doesn't reject."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id."""
    return keep_one(docs, SHINGLE, BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data in their texts is replaced by its kind in brackets."""
    return scrubbed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and their token ids (little-endian unsigned 32-bit integers), their number and the decoded text's sha256."""
    import public_tokenizers

    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    out = bpe_encoded(docs, public_tokenizers.path("word_bpe_49k.json"), ids_name=ids, text_name=decoded)
    return out.withColumns({
        free_name(docs, "n_tokens"): (F.octet_length(ids) / 4).cast("long"),
        free_name(docs, "decoded_sha256"): F.sha2(F.col(decoded).cast("binary"), 256)}).drop(decoded)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", tokens),
]

#: The stages rest on learned models and a tokenizer, which SQL can't express; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
