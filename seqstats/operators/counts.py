"""Counts per player and opening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstats.operators.shaping import union_all

# The count columns of the players' tables.
COUNTS = ["count_w", "won_w", "lost_w", "count_b", "won_b", "lost_b", "real_game_w", "real_game_b"]


def player_openings(games: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Games, wins, losses and deepest matches per player and opening, for each color.

    Names are grouped as written and only then lower-cased. For ``parts`` see ``count_names``.
    """
    return lower_names(count_names(games, keys, parts))


def count_names(games: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """The eight counts per ``username`` and opening.

    Each game row counts once for either player. Rows are dealt by ``keys`` and the player's id and counted where they arrive,
    in one shuffle of small rows: a player's counts lie together, for what follows by ``id`` too (``lower_names``). Sums before
    the shuffle would be wider than the rows and hardly fewer, since a player's games are scattered. With ``parts`` rows are
    dealt by ``keys`` and so many parts of each instead, by a hash of the player: the counts lie together by ``keys`` and can
    be written so without another shuffle. One task then reads all games that a player has under one of the keys; what it
    holds are the counts alone.
    """
    sides = F.array(
        F.struct(F.col("white").alias("username"), F.lit(3).alias("_side")),
        F.struct(F.col("black").alias("username"), F.lit(0).alias("_side")),
    )
    # Color and result in one small number: rows that are dealt are shuffled before they are counted.
    result = F.when(F.col("result") == "1-0", 1).when(F.col("result") == "0-1", 2).otherwise(0)
    rows = (
        games.where(F.col("matched_id").isNotNull())
        .select(*keys, "matched_id", "real_game", result.alias("_result"), F.inline(sides))
        .select(*keys, "username", "matched_id", "real_game", (F.col("_side") + F.col("_result")).cast("tinyint").alias("_how"))
    )
    part = F.lower("username") if parts is None else F.pmod(F.xxhash64("username"), F.lit(parts))
    rows = rows.repartition(*keys, part).withColumn("_part", part)
    white, black = F.col("_how") >= 3, F.col("_how") < 3
    first, second = F.col("_how") % 3 == 1, F.col("_how") % 3 == 2
    return rows.groupBy(*keys, "_part", "username", "matched_id").agg(
        F.count_if(white).alias("count_w"),
        F.count_if(white & first).alias("won_w"),
        F.count_if(white & second).alias("lost_w"),
        F.count_if(black).alias("count_b"),
        F.count_if(black & second).alias("won_b"),
        F.count_if(black & first).alias("lost_b"),
        F.sum(F.when(white, F.col("real_game")).otherwise(0)).alias("real_game_w"),
        F.sum(F.when(black, F.col("real_game")).otherwise(0)).alias("real_game_b"),
    ).drop("_part")


def lower_names(counts: DataFrame) -> DataFrame:
    keys = [c for c in counts.columns if c not in (*COUNTS, "username", "matched_id")]
    return counts.select(*keys, F.lower("username").alias("id"), "matched_id", *COUNTS)


def merge_counts(dfs: list[DataFrame]) -> DataFrame:
    """Counts of several tables (months) added up per player and opening."""
    return sum_counts(union_all(dfs))


def sum_counts(df: DataFrame) -> DataFrame:
    return df.repartition("id").groupBy("id", "matched_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def player_totals(counts: DataFrame) -> DataFrame:
    """Matched games per player and color."""
    return counts.groupBy("id").agg(
        F.sum("real_game_w").alias("total_count_w"), F.sum("real_game_b").alias("total_count_b")
    )


def join_totals(counts: DataFrame) -> DataFrame:
    """Counts with the player's totals beside them.

    A player has at most one row per opening here, so a window over the player stays
    within the dictionary's size and needs no second pass over the counts.
    """
    player = Window.partitionBy("id")
    return counts.where(F.col("id").isNotNull()).withColumns(
        {
            "total_count_w": F.sum("real_game_w").over(player),
            "total_count_b": F.sum("real_game_b").over(player),
        }
    )


def outer_fill(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of all frames on ``keys``, missing numbers as 0."""
    return reduce(lambda a, b: a.join(b, keys, "outer").fillna(0), dfs)


def distinct_keys(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def dedupe_known(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The first row per key by ``order``, without one the row whose other columns are least.

    Partial results keep hot keys cheap.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    first = (F.min(row) if order is None else F.min_by(row, F.col(order))).alias("r")
    return df.groupBy(key).agg(first).select(key, *[F.col("r")[c].alias(c) for c in rest]).select(*df.columns)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both frames, with the new frame's row where it has one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_version", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_version", F.lit(1)))
    latest = F.max_by(F.struct(*rest), "_version").alias("r")
    return both.groupBy(*keys).agg(latest).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*old.columns)


def num_countries(known: DataFrame) -> DataFrame:
    return known.agg(F.count("*").alias("num_countries"))
