"""The dictionary of named sequence prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.functions.moves import move_tokens, opening_id, sequence_key
from seqstats.operators.shaping import drop_matching


def union_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All tab-separated files of a pattern as one scan, every column a string."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(pattern)


def read_openings(spark: SparkSession, folder: str) -> DataFrame:
    """Openings of all ``*.tsv`` files with ``id`` and the normalised ``moves`` key."""
    return with_ids(drop_matching(union_files(spark, f"{folder}/*.tsv"), "^Unnamed|^_c[0-9]+$|^$"))


def with_ids(openings: DataFrame) -> DataFrame:
    return openings.withColumns(
        {
            "id": opening_id(F.col("eco"), F.col("name"), F.col("uci")),
            "moves": sequence_key(move_tokens(F.col("pgn"), None)),
        }
    )
