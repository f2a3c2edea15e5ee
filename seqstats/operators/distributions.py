"""Distributions of player probabilities, as value counts and as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.operators.shaping import METRICS


def distributions(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many players of each group have which probability: one row per key, metric and value, NULLs left out.

    The form is the same for a group of any size, and equal values are counted before the shuffle.
    """
    values = metric_values(df, keys).where("value IS NOT NULL")
    return values.groupBy(*keys, "metric", "value").agg(F.count("*").alias("players"))


def distribution_arrays(df: DataFrame, keys: list[str], suffix: str = "dist", parts: int = 1) -> DataFrame:
    """The four probabilities of each group as sorted arrays, NULLs left out; for groups that fit a row.

    With ``parts`` over 1 every group's players are dealt over so many rows, numbered by ``part``.
    """
    dealt = df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    arrays = [F.sort_array(F.collect_list(m)).alias(f"{m}_{suffix}") for m in METRICS]
    return dealt.groupBy(*keys, "part").agg(*arrays)


def metric_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per key, metric and value (NULL values included).

    Not by ``unpivot``, whose output Spark numbers anew in every use, so that equal shuffles are not seen as equal.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return df.select(*keys, F.inline(values))
