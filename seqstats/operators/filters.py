"""Row predicates of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_matched(df: DataFrame) -> DataFrame:
    return df.where(F.col("matched_id").isNotNull())


def result_flags(df: DataFrame) -> DataFrame:
    """Who won, as 0/1 flags; a draw or an unfinished game is neither."""
    return df.withColumns(
        {
            "white_won": (F.col("result") == "1-0").cast("int"),
            "black_won": (F.col("result") == "0-1").cast("int"),
        }
    )


# The default thresholds.
MIN_GAMES, ALPHA, MIN_DEV, MIN_PLAYERS = 50, 0.01, 0.5, 2000


def filter_min_games(df: DataFrame, k: int = MIN_GAMES) -> DataFrame:
    """Players with at least ``k`` games; a NULL total on either side drops the row."""
    return df.where(F.col("total_count_w") + F.col("total_count_b") >= k)


def filter_has_country(df: DataFrame) -> DataFrame:
    return df.where(F.col("country").isNotNull())


def filter_valid_id(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull() & (F.col("id") != "?"))


def filter_iso2(df: DataFrame) -> DataFrame:
    return df.where(F.length("country") == 2)


def filter_significant(
    df: DataFrame, mode: str = "played", alpha: float = ALPHA, min_dev: float = MIN_DEV, min_players: int = MIN_PLAYERS
) -> DataFrame:
    """Rows significant in ``mode``; a missing p-value, deviation or count is not."""
    check_choice("mode", mode, ("played", "won"))
    return df.where(
        (F.col(f"p_val_{mode}") < alpha)
        & (F.abs(f"dev_{mode}") > min_dev)
        & (F.col("num_players") >= min_players)
    )


def filter_outliers(df: DataFrame) -> DataFrame:
    """Points at least one standard deviation from the mean in either coordinate."""
    return df.where(
        (F.abs(F.col("p") - F.col("mean_p")) >= F.col("std_p"))
        | (F.abs(F.col("p_won") - F.col("mean_p_won")) >= F.col("std_p_won"))
    )


def drop_unresolved(df: DataFrame, col: str) -> DataFrame:
    return df.dropna(subset=[col])


def filter_side(df: DataFrame, side: str) -> DataFrame:
    check_choice("side", side, ("w", "b"))
    return df.where(F.col("color") == side)


def check_choice(what: str, value: str | int, allowed: tuple[str | int, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(map(str, allowed))}, not {value!r}")
