"""Significant deviations of countries from the global mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstats.functions.moves import last_mover
from seqstats.operators.filters import (
    ALPHA,
    MIN_DEV,
    MIN_PLAYERS,
    filter_iso2,
    filter_outliers,
    filter_side,
    filter_significant,
)
from seqstats.operators.probabilities import unstandardize
from seqstats.operators.shaping import sort_by_deviation

# Columns of the result.
COLUMNS = [
    "matched_id", "country", "p_val_played", "dev_played", "prob_played", "p_val_won", "dev_won", "prob_won",
    "color", "num_players", "name", "pgn",
]


def join_ks_country(ks: DataFrame, country: DataFrame) -> DataFrame:
    return ks.join(country, ["country", "matched_id"], "outer")


def join_player_counts(df: DataFrame, counts: DataFrame, how: str = "outer") -> DataFrame:
    return df.join(counts, "country", how)


def join_global(df: DataFrame, moments: DataFrame) -> DataFrame:
    return df.join(moments, "matched_id", "left")


def join_opening_names(df: DataFrame, openings: DataFrame) -> DataFrame:
    """Add the side that made an opening's last move, its name and its moves."""
    named = openings.select(
        F.col("id").alias("matched_id"), last_mover(F.col("pgn")).alias("color"), "name", "pgn"
    )
    return df.join(named, "matched_id")


def deviations(
    ks: DataFrame, country: DataFrame, counts: DataFrame, moments: DataFrame, openings: DataFrame
) -> DataFrame:
    """All test results of two-letter countries with scores, counts, moments and names."""
    joined = join_global(join_player_counts(join_ks_country(ks, country), counts), moments)
    return join_opening_names(filter_iso2(joined), openings)


def by_color(column: str, end: str = "") -> Column:
    """A column's value for the color that made the opening's last move."""
    return F.when(F.col("color") == "w", F.col(f"{column}_w{end}")).otherwise(F.col(f"{column}_b{end}"))


def colored_deviations(
    ks: DataFrame, country: DataFrame, counts: DataFrame, moments: DataFrame, openings: DataFrame
) -> DataFrame:
    """Test results, scores and probabilities of every opening in its own color, where none of them is missing.

    The rows of ``deviations`` that can be significant: those lack no side, so all joins are inner ones, countries without
    a two-letter code go before the joins, and the small tables are left to be broadcast by their measured size.
    """
    joined = filter_iso2(ks).join(filter_iso2(country), ["country", "matched_id"]).join(counts, "country")
    rows = join_opening_names(joined.join(moments, "matched_id"), openings).withColumns(
        {
            "p_val_played": by_color("p", "_p_value"),
            "dev_played": by_color("stand_p"),
            "p_val_won": by_color("p_won", "_p_value"),
            "dev_won": by_color("stand_p_won"),
        }
    )
    return unstandardize(rows).select(*COLUMNS)


def significant_deviations(
    ks: DataFrame, country: DataFrame, counts: DataFrame, moments: DataFrame, openings: DataFrame,
    mode: str = "played", color: str = "w", alpha: float = ALPHA, min_dev: float = MIN_DEV, min_players: int = MIN_PLAYERS,
) -> DataFrame:
    """Deviations of one color's openings that pass the tests in ``mode``."""
    rows = filter_side(colored_deviations(ks, country, counts, moments, openings), color)
    return filter_significant(rows, mode, alpha, min_dev, min_players)


def all_significant(
    ks: DataFrame, country: DataFrame, counts: DataFrame, moments: DataFrame, openings: DataFrame,
    mode: str = "played", alpha: float = ALPHA, min_dev: float = MIN_DEV, min_players: int = MIN_PLAYERS,
) -> DataFrame:
    """Significant deviations of both colors, found in one pass, the largest first."""
    rows = colored_deviations(ks, country, counts, moments, openings)
    return sort_by_deviation(filter_significant(rows, mode, alpha, min_dev, min_players), mode)


def significant_in_either(
    ks: DataFrame, country: DataFrame, counts: DataFrame, moments: DataFrame, openings: DataFrame,
    alpha: float = ALPHA, min_dev: float = MIN_DEV, min_players: int = MIN_PLAYERS,
) -> DataFrame:
    """Rows significant in either mode, with the flags ``played`` and ``won``: one pass for both results."""
    rows = colored_deviations(ks, country, counts, moments, openings)
    passed = [
        F.coalesce(
            (F.col(f"p_val_{m}") < alpha) & (F.abs(f"dev_{m}") > min_dev) & (F.col("num_players") >= min_players), F.lit(False)
        ).alias(m)
        for m in ("played", "won")
    ]
    return rows.select("*", *passed).where("played OR won")


def opening_profile(country: DataFrame, moments: DataFrame, openings: DataFrame, opening: str) -> DataFrame:
    """Countries' probabilities for one opening in its last mover's color.

    Each point has the global mean and deviation beside it and a flag for outliers.
    """
    color = last_mover(F.col("pgn")).alias("color")
    chosen = openings.where(F.col("id") == opening).select(F.col("id").alias("matched_id"), "name", color)
    points = country.where(F.col("matched_id") == opening).join(moments, "matched_id").join(chosen, "matched_id")

    points = points.select(
        "country",
        "name",
        "color",
        *[by_color(c).alias(c) for c in ("p", "p_won", "mean_p", "std_p", "mean_p_won", "std_p_won")],
    )
    far = filter_outliers(points).select("country").withColumn("outlier", F.lit(True))
    return points.join(far, "country", "left").fillna(False, ["outlier"])
