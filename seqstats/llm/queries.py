"""One query per operator, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqstats.llm import (
    bpe, decontamination, factorisation, interaction, lm_scoring, mixing, phrases, quality_rules, secrets_scan, simhash, suffix_dedup,
    toxicity, url_filters,
)
from seqstats.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.report(table(spark, folder, "pages"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encoded_digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return secrets_scan.findings(documents, secrets_scan.train(documents))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.report(table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return factorisation.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interaction.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_quality_rules, op3_url_filters, op4_byte_bpe, op5_secret_scans, op6_lm_scoring,
        op7_quality_classifier, op8_decontamination, op9_simhash_near_dedup, op10_toxicity, op11_source_mixing, op12_filter_audit,
        op13_phrase_mining,
    )
}

ORACLES: dict[str, str] = {
    "op3_url_filters": url_filters.SQL, "op8_decontamination": decontamination.SQL, "op11_source_mixing": mixing.SQL,
    "op12_filter_audit": interaction.SQL, "op13_phrase_mining": phrases.SQL,
}
