"""Probabilities per player, means per country and standard scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstats.operators.counts import join_totals
from seqstats.operators.filters import check_choice, filter_has_country
from seqstats.operators.shaping import METRICS

# Fixed value: added to every standard deviation before dividing by it.
EPS = 1e-17
# Registers of a distinct-count sketch, as a power of two.
SKETCH_BITS = 14


def player_shares(counts: DataFrame) -> DataFrame:
    """Share of games with an opening and share of those won; NULL for zero games."""
    joined = join_totals(counts)
    return joined.select(
        "id",
        "matched_id",
        "total_count_w",
        "total_count_b",
        F.try_divide("count_w", "total_count_w").alias("p_w"),
        F.try_divide("count_b", "total_count_b").alias("p_b"),
        F.try_divide("won_w", "count_w").alias("p_won_w"),
        F.try_divide("won_b", "count_b").alias("p_won_b"),
    )


def join_country(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Player rows with the profile's country, NULL if unknown."""
    return df.join(filter_has_country(profiles.select("id", "country")), "id", "left")


def player_probabilities(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    return join_country(player_shares(counts), profiles)


def country_player_counts(df: DataFrame) -> DataFrame:
    """Distinct players per country."""
    return df.groupBy("country").agg(F.count_distinct("id").alias("num_players"))


def player_sketches(df: DataFrame, keys: tuple[str, ...] = ("country",), size: int = SKETCH_BITS) -> DataFrame:
    """A distinct-count sketch of the players per key, of at most 2 ** ``size`` bytes whatever the number of players.

    Sketches can be stored per month and united later (``united_sketches``); ids are never shuffled. Rows without an id count
    for no one.
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg("id", F.lit(size)).alias("sketch"))


def united_sketches(sketches: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Sketches of several months or parts as one per key: the same as a sketch of all their rows."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def approx_player_counts(sketches: DataFrame) -> DataFrame:
    """Estimated distinct players, and the bounds that hold the exact number in all but one of about 300 cases.

    The standard error of united sketches is 1.04 / sqrt(2 ** size); the bounds are three of them wide.
    """
    estimate = F.hll_sketch_estimate("sketch")
    width = F.lit(3 * sketch_error())
    return sketches.withColumn("num_players", estimate).select(
        *[c for c in sketches.columns if c != "sketch"], "num_players",
        F.floor(F.col("num_players") * (1 - width)).alias("at_least"), F.ceil(F.col("num_players") * (1 + width)).alias("at_most"),
    )


def sketch_error(size: int = SKETCH_BITS) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / (1 << size) ** 0.5


def country_means(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "matched_id").agg(*[F.avg(m).alias(m) for m in METRICS])


def global_moments(df: DataFrame) -> DataFrame:
    """Mean and sample standard deviation per opening over all players, 0 if undefined."""
    moments = []
    for m in METRICS:
        moments += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    return df.groupBy("matched_id").agg(*moments).fillna(0)


def moment_states(df: DataFrame) -> DataFrame:
    """Per opening what its moments can be made from and brought up to date with: ``n``, ``mean`` and ``m2`` of each metric.

    ``m2`` is the sum of squared distances from the mean; NULL values count for nothing.
    """
    states = []
    for m in METRICS:
        squares = F.coalesce(F.var_pop(m) * F.count(m), F.lit(0.0))
        states += [F.count(m).alias(f"n_{m}"), F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}"), squares.alias(f"m2_{m}")]
    return df.groupBy("matched_id").agg(F.count("*").alias("n"), *states)


def updated_states(states: DataFrame, change: DataFrame, sign: int = 1) -> DataFrame:
    """States with those of more rows merged in (``sign`` 1), or of rows they hold taken out again (-1).

    Pairwise form, stable also where means are far from 0: merging adds the squared distance of the two means, weighted by how
    many values lie on either side. An opening without rows goes.
    """
    check_choice("sign", sign, (1, -1))
    change = change.select(*[F.col(c).alias(f"_{c}") for c in change.columns])
    both = states.join(change, F.col("matched_id") == F.col("_matched_id"), "full_outer")
    out = [F.coalesce("matched_id", "_matched_id").alias("matched_id"), (F.coalesce("n", F.lit(0)) + sign * F.coalesce("_n", F.lit(0))).alias("n")]
    for m in METRICS:
        na, nb = F.coalesce(f"n_{m}", F.lit(0)), sign * F.coalesce(f"_n_{m}", F.lit(0))
        a, b = F.coalesce(f"mean_{m}", F.lit(0.0)), F.coalesce(f"_mean_{m}", F.lit(0.0))
        n, apart = na + nb, b - a
        squares = F.coalesce(f"m2_{m}", F.lit(0.0)) + sign * F.coalesce(f"_m2_{m}", F.lit(0.0)) + apart * apart * F.try_divide(na * nb, n)
        out += [
            n.alias(f"n_{m}"), F.when(n > 0, a + apart * F.try_divide(nb, n)).otherwise(0.0).alias(f"mean_{m}"),
            F.when(n > 1, F.greatest(squares, F.lit(0.0))).otherwise(0.0).alias(f"m2_{m}"),
        ]
    return both.select(*out).where("n > 0")


def moments_of(states: DataFrame) -> DataFrame:
    """The moments that ``global_moments`` gives for the rows behind the states."""
    columns = []
    for m in METRICS:
        spread = F.when(F.col(f"n_{m}") > 1, F.sqrt(F.col(f"m2_{m}") / (F.col(f"n_{m}") - 1))).otherwise(0.0)
        columns += [F.col(f"mean_{m}"), spread.alias(f"std_{m}")]
    return states.select("matched_id", *columns)


def join_moments(country: DataFrame, moments: DataFrame) -> DataFrame:
    return country.join(moments, "matched_id")


def standardize(country: DataFrame, moments: DataFrame, eps: float = EPS) -> DataFrame:
    """Country means with their distance from the global mean in standard deviations."""
    scores = [((F.col(m) - F.col(f"mean_{m}")) / (F.col(f"std_{m}") + eps)).alias(f"stand_{m}") for m in METRICS]
    return join_moments(country, moments).select("country", "matched_id", *METRICS, *scores)


def unstandardize(df: DataFrame, side: str | None = None) -> DataFrame:
    """Add the probabilities behind ``dev_played`` and ``dev_won``.

    The moments are those of ``side``, or of each row's ``color`` if no side is given.
    """
    if side is not None:
        check_choice("side", side, ("w", "b"))
    chosen = F.col("color") if side is None else F.lit(side)

    def moment(name: str) -> Column:
        return F.when(chosen == "w", F.col(f"{name}_w")).otherwise(F.col(f"{name}_b"))

    return df.withColumns(
        {
            "prob_played": F.col("dev_played") * moment("std_p") + moment("mean_p"),
            "prob_won": F.col("dev_won") * moment("std_p_won") + moment("mean_p_won"),
        }
    )
