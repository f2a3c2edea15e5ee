"""A corpus pipeline of five stages; each calls one operator of ``seqstats.llm`` and works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the rows it keeps, with the columns of ``documents`` (the last
stage: the encoded corpus). ``n_chars`` follows the text where a stage changes it. Models are learned from the tables of
``sf_dir``, whatever the stages before have removed. Empty tables pass through as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.llm import bpe, decontamination, quality_rules, secrets_scan, simhash
from seqstats.llm.common import table
from seqstats.session import fresh_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: None: trained models, fingerprints and tokens have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def measured(docs: DataFrame) -> DataFrame:
    """The rows with the length of their text as ``n_chars``, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.DISTANCE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand in the benchmark; those mostly made of such spans go."""
    return measured(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return measured(secrets_scan.redact(docs, secrets_scan.train(table(spark, sf_dir, "documents"))))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of the ids and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.decode(bpe.encode(docs, path, pattern), path).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
