"""Column shaping, unions and sorts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep the mapped columns, under their new names, in the mapping's order."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def product_columns(prefixes: list[str], sides: list[str]) -> list[str]:
    """``["", "won_"]`` and ``["w", "b"]`` give ``w, b, won_w, won_b``."""
    return [p + s for p in prefixes for s in sides]


# The ends of the result's column names.
SUFFIXES = product_columns(["", "won_"], ["w", "b"])
METRICS = [f"p_{s}" for s in SUFFIXES]


def flatten_profile(df: DataFrame) -> DataFrame:
    """``id`` in lower case beside the fields of ``profile``."""
    fields = [f.name for f in df.schema["profile"].dataType.fields if f.name != "id"]
    return df.select(F.lower("id").alias("id"), *[F.col("profile")[f].alias(f) for f in fields])


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """All rows, with the first frame's columns; a frame lacking one of them is an error, further columns are left out."""
    if not dfs:
        raise ValueError("no frames to unite")
    first, *others = dfs
    for number, df in enumerate(others, 2):
        if missing := [c for c in first.columns if c not in df.columns]:
            raise ValueError(f"frame {number} lacks the columns {', '.join(missing)}")
    united = first
    for df in others:
        united = united.unionByName(df.drop(*[c for c in df.columns if c not in first.columns]))
    return united


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows and all columns, NULL where a frame lacks the column."""
    return a.unionByName(b, allowMissingColumns=True)


def union_sides(white: DataFrame, black: DataFrame) -> DataFrame:
    return white.unionByName(black)


def sort_by_sequence(openings: DataFrame, moves: str = "uci") -> DataFrame:
    return openings.orderBy(moves, "id")


def sort_by_deviation(df: DataFrame, mode: str = "played") -> DataFrame:
    return df.orderBy(F.desc(f"dev_{mode}"), "matched_id", "country")


def sort_by_player(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("id"), F.desc("matched_id"))


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
