"""The pipeline's jobs: each reads named stages, runs one plan and writes named stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.functions.numbers import bin_counts
from seqstats.operators import geo
from seqstats.operators.counts import count_names, lower_names, player_openings, sum_counts
from seqstats.operators.distributions import distributions
from seqstats.operators.filters import ALPHA, MIN_DEV, MIN_GAMES, MIN_PLAYERS, filter_has_country, filter_min_games
from seqstats.operators.hierarchy import count_along_paths, prefix_closure
from seqstats.operators.ks import EXACT_LIMIT, ks_test
from seqstats.operators.matching import match_prefixes
from seqstats.operators.membership import stored_filter
from seqstats.operators.probabilities import (
    country_means,
    country_player_counts,
    global_moments,
    player_probabilities,
    standardize,
)
from seqstats.operators.profiles import new_player_batches
from seqstats.operators.shaping import flatten_profile, sort_by_deviation, union_all, union_evolving
from seqstats.operators.significance import opening_profile, significant_in_either
from seqstats.session import delete_path, move_path, path_exists, small_on_disk
from seqstats.sources.features import read_collection, read_features, read_members, write_features, write_metadata
from seqstats.sources.ledger import BUCKETS, put_months, state, withdraw_months
from seqstats.sources.records import parse_games, read_game_records
from seqstats.sources.stages import (
    month_range,
    read_known,
    read_month_stages,
    read_stage,
    replace_table,
    stage_path,
    write_csv,
    write_stage,
)

# The tables of known entities.
KNOWN_PLAYERS = "id STRING, country STRING"
KNOWN_COUNTRIES = "ISO_A2 STRING, country STRING, ISO_A3 STRING"


def games_from_records(records: DataFrame, openings: DataFrame, n: int = 10) -> DataFrame:
    """Records to game rows, one per matching opening."""
    return match_prefixes(parse_games(records, n), openings, "original_moves", n)


def country_probabilities(players: DataFrame, min_games: int = MIN_GAMES) -> dict[str, DataFrame]:
    """Player counts, global moments and standardised means of countries."""
    counted = filter_min_games(players, min_games)
    located = filter_has_country(counted)
    moments = global_moments(counted)
    return {
        "player_count": country_player_counts(located),
        "mean_std": moments,
        "countries": standardize(country_means(located), moments),
    }


def run_games(spark: SparkSession, root: str, name: str, pgn: str, openings: DataFrame, n: int = 10) -> None:
    write_stage(games_from_records(read_game_records(spark, pgn), openings, n), root, "games", name)


def run_player_openings(spark: SparkSession, root: str, name: str, openings: DataFrame | None = None) -> None:
    """Count the matches of a games stage.

    With the dictionary given, only deepest matches are read and shuffled, and their sums
    are spread to the openings above; the result is the same.
    """
    games = read_stage(spark, root, "games", name)
    if openings is None:
        counted = player_openings(games)
    else:
        counted = counts_along_paths(games.where("real_game = 1"), openings)
    write_stage(counted, root, "players", name)


def counts_along_paths(deepest: DataFrame, openings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Player counts of all matches from the rows of the deepest ones."""
    return lower_names(count_along_paths(count_names(deepest, keys), prefix_closure(openings)))


def run_merge_months(spark: SparkSession, root: str, start: str, end: str | None = None) -> str:
    """Add up the months' tables; the result is named by the first and the last month."""
    last = month_range(start, end)[-1]
    merged = sum_counts(read_month_stages(spark, root, "players", start, last))
    return write_stage(merged, root, "players", f"{start}_{last}")


def run_add_months(spark: SparkSession, root: str, start: str, end: str | None = None, buckets: int = BUCKETS) -> int:
    """Add the months' tables to the ledger, or replace them there; only these months are read. Gives the version."""
    named = month_range(start, end or start)
    tables = [read_stage(spark, root, "players", m).withColumn("month", F.lit(m)) for m in named]
    return put_months(spark, ledger_path(root), union_all(tables), named, buckets)


def run_withdraw_months(spark: SparkSession, root: str, start: str, end: str | None = None) -> int:
    return withdraw_months(spark, ledger_path(root), month_range(start, end or start))


def run_ledger_table(spark: SparkSession, root: str, name: str) -> str:
    """The ledger's sums as the players' table ``name``, for the jobs that follow."""
    return write_stage(state(spark, ledger_path(root)).drop("months"), root, "players", name)


def ledger_path(root: str) -> str:
    return stage_path(root, "players", "ledger").removesuffix(".parquet")


def run_new_player_batches(spark: SparkSession, root: str, name: str, known: str = "known_players") -> DataFrame:
    """Schedule for looking up the profiles of players not known yet.

    A large table of known players is met through its filter, which is built once for each state of the table.
    """
    path = stage_path(root, "players", known)
    known_df = read_known(spark, path, "id", KNOWN_PLAYERS)
    seen = None
    if known_df.inputFiles() and not small_on_disk(known_df):
        known_df = spark.read.parquet(path).select("id")  # repeated rows do not matter here
        seen = stored_filter(known_df, "id", filters_path(path))
    return new_player_batches(read_stage(spark, root, "players", name), known_df, seen)


def filters_path(path: str) -> str:
    return f"{path.removesuffix('.parquet')}_filters"


def run_merge_profiles(spark: SparkSession, root: str, responses: DataFrame, known: str = "known_players") -> None:
    """Add looked-up profiles (``id``, ``profile``) to the known players.

    The next table is written beside the present one and then takes its place.
    """
    path = stage_path(root, "players", known)
    replace_table(union_evolving(read_known(spark, path, "id", KNOWN_PLAYERS), flatten_profile(responses)), path)
    delete_path(spark, filters_path(path))  # of the former table; a filter is found by the table's files alone


def run_player_probabilities(spark: SparkSession, root: str, name: str, known: str = "known_players") -> None:
    profiles = read_known(spark, stage_path(root, "players", known), "id", KNOWN_PLAYERS)
    write_stage(player_probabilities(read_stage(spark, root, "players", name), profiles), root, "players", name, "prob")


def run_country_probabilities(spark: SparkSession, root: str, name: str, min_games: int = MIN_GAMES) -> None:
    """Write the three tables from one reading of the players; the scores reuse the moments already written."""
    players = read_stage(spark, root, "players", name, "prob").persist()
    tables = country_probabilities(players, min_games)
    write_stage(tables["player_count"], root, "countries", name, "player_count")
    moments = spark.read.parquet(write_stage(tables["mean_std"], root, "openings", name, "mean_std"))
    located = filter_has_country(filter_min_games(players, min_games))
    write_stage(standardize(country_means(located), moments), root, "countries", name)
    players.unpersist()


def run_distributions(spark: SparkSession, root: str, name: str, min_games: int = MIN_GAMES) -> None:
    players = filter_min_games(read_stage(spark, root, "players", name, "prob"), min_games)
    write_stage(distributions(players, ["matched_id"]), root, "distributions", name, "global")
    by_country = distributions(filter_has_country(players), ["matched_id", "country"])
    write_stage(by_country, root, "distributions", name, "country")


def run_ks_test(
    spark: SparkSession, root: str, name: str, min_games: int = MIN_GAMES, method: str = "auto", exact_limit: int = EXACT_LIMIT
) -> None:
    players = filter_min_games(read_stage(spark, root, "players", name, "prob"), min_games)
    write_stage(ks_test(players, method, exact_limit), root, "ks_test", name)


def run_significant(
    spark: SparkSession, root: str, name: str, openings: DataFrame,
    alpha: float = ALPHA, min_dev: float = MIN_DEV, min_players: int = MIN_PLAYERS,
) -> None:
    """One CSV folder per mode, sorted by deviation; the tables are joined once for both."""
    tables = (
        read_stage(spark, root, "ks_test", name),
        read_stage(spark, root, "countries", name),
        read_stage(spark, root, "countries", name, "player_count"),
        read_stage(spark, root, "openings", name, "mean_std"),
    )
    rows = significant_in_either(*tables, openings, alpha, min_dev, min_players).persist()
    for mode in ("played", "won"):
        found = sort_by_deviation(rows.where(mode).drop("played", "won"), mode)
        write_csv(found, stage_path(root, "significant", name, mode).replace(".parquet", ".csv"))
    rows.unpersist()


def run_known_countries(spark: SparkSession, root: str, name: str, iso: DataFrame) -> None:
    path = stage_path(root, "countries", "known_countries")
    known = read_known(spark, path, "ISO_A2", KNOWN_COUNTRIES)
    replace_table(geo.known_countries(read_stage(spark, root, "countries", name), iso, known), path)


def run_feature_enrichment(
    spark: SparkSession, root: str, name: str, openings: DataFrame, features: str, out: str, moments: str | None = None,
    document: bool = False,
) -> None:
    """Write the enriched features, the collection's other members and the metadata below ``out``.

    As lines by default; ``document`` puts features and metadata into one document each, for maps that fit a row. Members of
    earlier metadata that are not written anew are kept.
    """
    country = read_stage(spark, root, "countries", name)
    counts = read_stage(spark, root, "countries", name, "player_count")
    known = read_known(spark, stage_path(root, "countries", "known_countries"), "ISO_A2", KNOWN_COUNTRIES)
    enriched = geo.feature_enrichment(country, counts, known, read_features(spark, features))
    collection = read_collection(spark, features)
    if document:
        write_features(enriched, f"{out}/countries.geojson", document=True, collection=collection)
    else:
        write_features(enriched, f"{out}/countries.geojsonl")
        collection.select(F.to_json("members")).write.mode("overwrite").text(f"{out}/countries_collection.json")
    resolved = geo.drop_unresolved(geo.map_iso3(country, known), "country")
    described = geo.opening_metadata(openings, read_stage(spark, root, "openings", moments or name, "mean_std"), resolved)
    path = f"{out}/enrichment_metadata" + (".json" if document else "")
    previous = read_members(spark, path, document) if path_exists(spark, path) else None
    write_metadata(described, known.agg(F.count("*")), bin_counts(), f"{path}_next", document, previous)
    move_path(spark, f"{path}_next", path)


def run_opening_profile(spark: SparkSession, root: str, name: str, openings: DataFrame, opening: str) -> DataFrame:
    known = read_known(spark, stage_path(root, "countries", "known_countries"), "ISO_A2", KNOWN_COUNTRIES)
    country = geo.country_names(read_stage(spark, root, "countries", name), known)
    return opening_profile(country, read_stage(spark, root, "openings", name, "mean_std"), openings, opening)
