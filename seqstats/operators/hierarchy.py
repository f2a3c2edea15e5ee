"""The opening hierarchy and counts rolled up along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstats.functions.moves import token_count
from seqstats.operators.counts import COUNTS
from seqstats.operators.matching import chain_by_shuffle

# Ends a token of a key; below everything that a token holds.
END = "\x01"
SIX_COUNTS = ["count_w", "won_w", "lost_w", "count_b", "won_b", "lost_b"]


def _paths(openings: DataFrame, moves: str) -> DataFrame:
    """Per opening the ids from its root to itself."""
    own = openings.where(F.col(moves) != "").select("id", F.col(moves).alias("key"))
    entries = own.select("key", "id", F.lit(None).cast("string").alias("name"), token_count(F.col("key")).alias("tokens"))
    # Openings of equal sequence lie on one path, by id: keep those up to the opening itself.
    return chain_by_shuffle(own, entries, "key", None).select(
        "id", F.expr("transform(filter(chain, m -> m.moves != key or m.id <= id), m -> m.id)").alias("path")
    )


def prefix_edges(openings: DataFrame, moves: str = "moves") -> DataFrame:
    """Every opening with its parent, the longest other opening it starts with."""
    return _paths(openings, moves).select(
        F.col("id").alias("child_id"), F.get("path", F.size("path") - 2).alias("parent_id")
    )


def prefix_closure(openings: DataFrame, moves: str = "moves") -> DataFrame:
    """Every opening with itself (``depth`` 0) and all openings ``depth`` steps above it."""
    return _paths(openings, moves).select(
        "id", F.posexplode(F.reverse("path")).alias("depth", "ancestor_id")
    ).select("id", "ancestor_id", "depth")


def opening_intervals(openings: DataFrame, moves: str = "moves") -> DataFrame:
    """Every opening as an interval of numbers: ``first``, ``last`` and ``depth`` (openings on its path).

    Openings are numbered in the order of their tokens, each right before all openings below it; these are the ones whose
    ``first`` lies between its ``first`` and ``last``, so "above" is a comparison. Only the dictionary's keys pass through the
    one sort that numbers them; counts never do.
    """
    key = F.concat(F.regexp_replace(moves, " ", END), F.lit(END))
    own = openings.where(F.col(moves) != "").select(F.col("id").alias("_id"), key.alias("_key"))
    numbered = own.select("_id", F.row_number().over(Window.orderBy("_key", "_id")).alias("first"))
    paths = _paths(openings, moves)
    sizes = paths.select(F.explode("path").alias("_node")).groupBy("_node").agg(F.count("*").alias("_size"))
    placed = paths.select("id", F.size("path").alias("depth")).join(sizes, F.col("id") == F.col("_node"))
    return placed.join(numbered, F.col("id") == F.col("_id")).select(
        "id", "first", (F.col("first") + F.col("_size") - 1).cast("int").alias("last"), "depth"
    )


def _played(counts: DataFrame, openings: DataFrame, moves: str) -> DataFrame:
    """Counts with ``_base``: the depth of the player's topmost played opening on the opening's path.

    A player's openings are walked in the order of their intervals: one is a base if none before it reaches over it, else its
    base is the last one before it (of repeated rows the first is the base). A row carries three numbers, so a player's memory is linear in the player's rows, and
    counts are shuffled by player once.
    """
    places = opening_intervals(openings, moves).withColumnRenamed("id", "_opening")
    before = Window.partitionBy("id").orderBy("first")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    base = reach.isNull() | (reach < F.col("first"))
    placed = counts.where("id IS NOT NULL").join(places, F.col("matched_id") == F.col("_opening")).withColumn("_top", base)
    of_base = F.last(F.when(F.col("_top"), F.col("depth")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_base", of_base).drop("_opening", "first", "last", "depth")


def count_along_paths(counts: DataFrame, closure: DataFrame) -> DataFrame:
    """Counts of deepest matches as counts of all matches.

    The same rows as counting every match of every game, but games are added up per
    deepest opening first and only those sums are spread to the openings above.
    """
    up = closure.select(F.col("id").alias("matched_id"), "ancestor_id", "depth")
    own = [F.sum(c).alias(c) for c in SIX_COUNTS]
    real = [F.sum(F.when(F.col("depth") == 0, F.col(c)).otherwise(0)).alias(c) for c in ("real_game_w", "real_game_b")]
    keys = [c for c in counts.columns if c not in (*COUNTS, "matched_id")]
    above = counts.join(up, "matched_id")
    return above.groupBy(*keys, F.col("ancestor_id").alias("matched_id")).agg(*own, *real)


def base_nodes(counts: DataFrame, openings: DataFrame, moves: str = "moves") -> DataFrame:
    """Per player the played openings without a played opening above them."""
    return _played(counts.select("id", "matched_id"), openings, moves).where("_top").select("id", "matched_id")


def rollup_counts(counts: DataFrame, openings: DataFrame, moves: str = "moves") -> DataFrame:
    """Per player the six counts of every opening including all openings below it.

    Rows appear for the player's base openings and everything between them and a played
    opening, also where the opening in between was not played itself.
    """
    paths = _paths(openings, moves).select(F.col("id").alias("_opening"), "path")
    below = F.slice("path", F.col("_base"), F.size("path"))
    summed = (
        _played(counts, openings, moves)
        .join(paths, F.col("matched_id") == F.col("_opening"))
        .select("id", F.explode(below).alias("matched_id"), *SIX_COUNTS)
        .groupBy("id", "matched_id")
        .agg(*[F.sum(c).alias(c) for c in SIX_COUNTS])
    )
    return summed.where(sum(F.col(c) for c in SIX_COUNTS) > 0)
