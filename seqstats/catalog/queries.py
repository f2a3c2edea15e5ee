"""One query per operator and job, each over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqstats.catalog.fixture import Inputs, rounded
from seqstats.functions import moves, numbers
from seqstats.operators import (
    counts,
    distributions,
    filters,
    geo,
    hierarchy,
    ks,
    matching,
    membership,
    probabilities,
    profiles,
    shaping,
    significance,
)
from seqstats.operators.shaping import METRICS, SUFFIXES
from seqstats.plans import jobs
from seqstats.session import fresh_dir, move_path, path_exists, small_on_disk, written
from seqstats.sources import features, ledger, openings, records, stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Thresholds fitting the tables' 30 to 70 players per country.
LEVELS = {"alpha": 0.05, "min_dev": 0.3, "min_players": 40}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a query under its function's name; doubles are rounded for comparison."""
    QUERIES[build.__name__] = lambda spark, folder: rounded(build(Inputs(spark, folder)))
    return build


# --- game records ------------------------------------------------------------------------


def record_text(games: DataFrame) -> DataFrame:
    """Games as text records with comments, variations and optional tags."""

    def line(tag: str, value) -> F.Column:
        return F.concat(F.lit(f'[{tag} "'), value, F.lit('"]\n'))

    numbered = F.transform(
        F.split("moves", " "),
        lambda m, i: F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "), m)).otherwise(m),
    )
    remark = F.when(F.col("result") == "1-0", " { a (quiet) start } ( 1. other (1. deeper) move! ) $3").otherwise("")
    return games.select(
        F.concat(
            line("Event", F.concat(F.lit("Rated game "), "month")),
            line("White", F.col("white")),
            line("Black", F.col("black")),
            line("Result", F.col("result")),
            line("WhiteElo", (F.col("white").cast("int") + 1000).cast("string")),
            F.when(F.col("result") != "1/2-1/2", line("BlackElo", (F.col("black").cast("int") + 1000).cast("string")))
            .otherwise(""),
            F.coalesce(line("Opening", F.col("original_name")), F.lit("")),
            F.lit("\n"),
            F.element_at(numbered, 1),
            remark,
            F.lit(" "),
            F.array_join(F.slice(numbered, F.lit(2), F.size(numbered)), " "),
            F.lit("+ "),
            "result",
            F.lit("\n"),
        ).alias("value")
    )


def written_records(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "records")
    record_text(i.games()).write.text(path)
    return records.read_game_records(i.spark, path)


@query
def read_game_records(i: Inputs) -> DataFrame:
    return written_records(i).select(F.rtrim(F.regexp_replace("record", r"\n+$", "")).alias("record"))


@query
def header_columns(i: Inputs) -> DataFrame:
    return records.header_columns(written_records(i)).drop("record")


@query
def opening_name(i: Inputs) -> DataFrame:
    return i.games().select("white", "black", "moves", moves.opening_name(F.col("original_name")).alias("opening_name"))


@query
def move_tokens(i: Inputs) -> DataFrame:
    found = records.header_columns(written_records(i))
    return found.select(
        "white",
        "black",
        F.array_join(moves.move_tokens(F.col("record")), "|").alias("tokens"),
        F.array_join(moves.move_tokens(F.col("record"), 3), "|").alias("first_three"),
    )


@query
def sequence_key(i: Inputs) -> DataFrame:
    tokens = F.slice(F.split("moves", " "), 1, 3)
    return i.games().select("white", "black", moves.sequence_key(tokens).alias("key"))


@query
def ordered_sequence(i: Inputs) -> DataFrame:
    return i.sequences()


@query
def shape_columns(i: Inputs) -> DataFrame:
    return shaping.shape_columns(i.games(), {"black": "second", "white": "first", "result": "score"})


@query
def drop_matching(i: Inputs) -> DataFrame:
    return shaping.drop_matching(i.counts(), "^real_game|^lost")


@query
def flatten_profile(i: Inputs) -> DataFrame:
    profile = F.struct("country", F.length("country").alias("code_length"))
    named = i.profiles().select(F.concat(F.lit("Player"), "id").alias("id"), profile.alias("profile"))
    return shaping.flatten_profile(named)


@query
def product_columns(i: Inputs) -> DataFrame:
    named = shaping.product_columns(["p_", "p_won_"], ["w", "b"])
    return i.players().select("id", "matched_id", *[F.col(c).alias(f"share_{c}") for c in named])


# --- dictionary and stages ------------------------------------------------------------------


def written_openings(i: Inputs) -> str:
    """The dictionary as files ``*.tsv``, some columns of which are to be left out."""
    path = fresh_dir(i.spark, "openings")
    table = i.openings().select("eco", "name", "pgn", "uci", F.lit("x").alias("Unnamed: 0"))
    table.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/written")
    for k, name in enumerate(sorted(f for f in i.spark.read.text(f"{path}/written").inputFiles())):
        move_path(i.spark, name, f"{path}/part{k}.tsv")
    return path


@query
def union_files(i: Inputs) -> DataFrame:
    return openings.union_files(i.spark, f"{written_openings(i)}/*.tsv")


@query
def read_openings(i: Inputs) -> DataFrame:
    return openings.read_openings(i.spark, written_openings(i))


@query
def read_stage(i: Inputs) -> DataFrame:
    root = fresh_dir(i.spark, "stage")
    stages.write_stage(i.counts(), root, "players", "all.parquet")
    return stages.read_stage(i.spark, root, "players", "all")


@query
def read_columns(i: Inputs) -> DataFrame:
    return stages.read_columns(i.table("customer"), ["c_custkey", "c_mktsegment"])


def month_bounds(i: Inputs) -> tuple[str, str]:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return tuple(i.table("orders").agg(F.min(month), F.max(month)).first())


@query
def month_range(i: Inputs) -> DataFrame:
    months = i.spark.createDataFrame([(m,) for m in stages.month_range(*month_bounds(i))], "month STRING")
    orders = i.table("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.join(orders, "month", "left").fillna(0)


def write_monthly(i: Inputs, path: str) -> tuple[str, str]:
    """The counts of all months, one folder each; gives the first and the last month."""
    bounds = month_bounds(i)
    parts = stages.month_parts(i.spark, len(stages.month_range(*bounds)))
    stages.write_months(i.monthly(parts), path, dealt=True)
    return bounds


@query
def read_months(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "months")
    return stages.read_months(i.spark, path, *write_monthly(i, path))


@query
def read_known(i: Inputs) -> DataFrame:
    """Two conflicting rows for every code; the one seen first counts."""
    path = fresh_dir(i.spark, "known")
    first = i.iso().withColumn("seen", F.lit(1))
    later = i.iso().select("ISO_A2", F.lower("ISO_A3").alias("ISO_A3"), F.lit("a later name").alias("country"), F.lit(2).alias("seen"))
    later.unionByName(first).write.parquet(path)
    return stages.read_known(i.spark, path, "ISO_A2", jobs.KNOWN_COUNTRIES, "seen").drop("seen")


@query
def write_stage(i: Inputs) -> DataFrame:
    return i.spark.read.parquet(stages.write_stage(i.iso(), fresh_dir(i.spark, "stage"), "countries", "known_countries"))


@query
def write_stage_gzip(i: Inputs) -> DataFrame:
    root = fresh_dir(i.spark, "stage")
    return i.spark.read.parquet(stages.write_stage(i.profiles(), root, "players", "known", compression="gzip"))


@query
def write_csv(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "csv")
    table = i.table("customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"))
    stages.write_csv(table, path)
    schema = "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE"
    return i.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query
def checkpointed(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "profiles")
    known, found = i.profiles().where("country IS NULL"), i.profiles().where("country IS NOT NULL")
    stages.checkpointed(found.where("length(country) = 2"), path, 0)
    stages.checkpointed(found.where("length(country) = 2"), path, 0)
    stages.checkpointed(found.where("length(country) <> 2"), path, 1)
    return stages.promote(i.spark, path, known)


@query
def promote_resumed(i: Inputs) -> DataFrame:
    """A collection that stopped right after its commit point, and went on with one more batch."""
    path = fresh_dir(i.spark, "profiles")
    found = i.profiles().where("country IS NOT NULL")
    stages.checkpointed(found.where("length(country) = 2"), path, 0)
    stages.commit_batches(i.spark, path, i.profiles().where("country IS NULL"))
    stages.checkpointed(found.where("length(country) <> 2"), path, 0)
    return stages.promote(i.spark, path, stages.read_known(i.spark, path, "id", jobs.KNOWN_PLAYERS))


# --- filters ----------------------------------------------------------------------------------


@query
def filter_matched(i: Inputs) -> DataFrame:
    matched = matching.match_by_name_and_prefix(i.games(), i.openings())
    return filters.filter_matched(matched).select("white", "black", "moves", "matched_id")


@query
def result_flags(i: Inputs) -> DataFrame:
    return filters.result_flags(i.games().select("white", "black", "result"))


@query
def filter_min_games(i: Inputs) -> DataFrame:
    return filters.filter_min_games(counts.player_totals(i.counts()), 80)


@query
def filter_has_country(i: Inputs) -> DataFrame:
    return filters.filter_has_country(i.profiles())


@query
def filter_valid_id(i: Inputs) -> DataFrame:
    named = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_mktsegment") == "MACHINERY", "?").otherwise(F.col("c_name"))
    return filters.filter_valid_id(i.table("customer").select(named.alias("id"), "c_nationkey"))


@query
def filter_iso2(i: Inputs) -> DataFrame:
    return filters.filter_iso2(i.profiles())


def white_tests(i: Inputs) -> DataFrame:
    i.share()
    joined = significance.join_player_counts(significance.join_ks_country(tested(i), i.standardized()), i.player_counts())
    return joined.select(
        "matched_id",
        "country",
        F.col("p_w_p_value").alias("p_val_played"),
        F.col("stand_p_w").alias("dev_played"),
        "num_players",
    )


def tested(i: Inputs) -> DataFrame:
    """All countries' test results, with the large-sample p-value."""
    return ks.ks_test(i.counted(), "asymp")


@query
def filter_significant(i: Inputs) -> DataFrame:
    return filters.filter_significant(white_tests(i), "played", **LEVELS)


@query
def filter_outliers(i: Inputs) -> DataFrame:
    i.share()
    joined = probabilities.join_moments(i.means(), i.moments())
    names = {"p_w": "p", "p_won_w": "p_won", "mean_p_w": "mean_p", "std_p_w": "std_p",
             "mean_p_won_w": "mean_p_won", "std_p_won_w": "std_p_won"}
    points = joined.select("country", "matched_id", *[F.col(old).alias(new) for old, new in names.items()])
    return filters.filter_outliers(points)


@query
def drop_unresolved(i: Inputs) -> DataFrame:
    codes = i.profiles().withColumnRenamed("country", "ISO_A2")
    return filters.drop_unresolved(geo.resolve_country(codes, i.iso()), "country")


@query
def filter_side(i: Inputs) -> DataFrame:
    named = significance.join_opening_names(i.moments().select("matched_id"), i.openings())
    return filters.filter_side(named, "b")


# --- matching and hierarchy ---------------------------------------------------------------------

GAME = ["white", "black", "moves", "result"]


@query
def match_prefixes(i: Inputs) -> DataFrame:
    return i.matches().select(*GAME, "matched_id", "matched_moves", "real_game")


@query
def match_prefixes_by_shuffle(i: Inputs) -> DataFrame:
    """The way of a dictionary too large to broadcast."""
    entries = i.openings().select(
        F.col("moves").alias("key"), "id", "name", moves.token_count(F.col("moves")).alias("tokens")
    )
    chained = matching.chain_by_shuffle(i.games().select(*GAME), entries, "moves", 10)
    matches = chained.select(*GAME, F.posexplode("chain").alias("pos", "m"), F.size("chain").alias("n"))
    real = (F.col("pos") == F.col("n") - 1).cast("long").alias("real_game")
    return matches.select(*GAME, F.col("m.id").alias("matched_id"), F.col("m.moves").alias("matched_moves"), real)


@query
def match_event_sequences(i: Inputs) -> DataFrame:
    """Event sequences against every sequence of up to three events as a named prefix."""
    sequences = i.sequences()
    known = sequences.select(F.explode(F.slice(moves.prefixes(F.col("moves")), 1, 3)).alias("moves")).distinct()
    return matching.match_prefixes(sequences, known.select(F.col("moves").alias("id"), "moves"))


@query
def deepest_match(i: Inputs) -> DataFrame:
    return matching.deepest_match(i.games().select(*GAME), i.openings())


@query
def match_by_name_and_prefix(i: Inputs) -> DataFrame:
    return matching.match_by_name_and_prefix(i.games().select(*GAME, "original_name"), i.openings())


@query
def prefix_edges(i: Inputs) -> DataFrame:
    return hierarchy.prefix_edges(i.openings())


@query
def prefix_closure(i: Inputs) -> DataFrame:
    return hierarchy.prefix_closure(i.openings())


@query
def opening_intervals(i: Inputs) -> DataFrame:
    return hierarchy.opening_intervals(i.openings())


def deepest_counts(i: Inputs) -> DataFrame:
    deepest = matching.deepest_match(i.games(), i.openings()).withColumn("real_game", F.lit(1))
    return counts.player_openings(deepest)


@query
def base_nodes(i: Inputs) -> DataFrame:
    return hierarchy.base_nodes(deepest_counts(i), i.openings())


@query
def rollup_counts(i: Inputs) -> DataFrame:
    return hierarchy.rollup_counts(deepest_counts(i), i.openings())


@query
def exact_sequence_lookup(i: Inputs) -> DataFrame:
    shown = F.concat(F.lit("1. "), F.substring_index("moves", " ", 2)).alias("pgn")
    return matching.exact_sequence_lookup(i.games().select("white", "black", shown), i.openings())


@query
def last_mover(i: Inputs) -> DataFrame:
    return i.openings().select("id", moves.last_mover(F.col("pgn")).alias("color"))


@query
def opening_id(i: Inputs) -> DataFrame:
    part = i.table("part")
    code = moves.opening_id(F.concat(F.substring("p_type", 1, 1), F.lit("00")), F.col("p_name"), F.concat_ws(" ", "p_type", "p_partkey"))
    return part.select("p_partkey", code.alias("id"))


# --- joins -----------------------------------------------------------------------------------------


@query
def outer_fill(i: Inputs) -> DataFrame:
    games = i.matches()
    sides = [
        games.where(F.col("result") == won).groupBy(F.col(side).alias("username"), "matched_id").agg(F.count("*").alias(name))
        for side, won, name in (("white", "1-0", "won_w"), ("white", "0-1", "lost_w"), ("black", "0-1", "won_b"))
    ]
    return counts.outer_fill(sides, ["username", "matched_id"])


@query
def join_totals(i: Inputs) -> DataFrame:
    return counts.join_totals(i.counts())


@query
def join_country(i: Inputs) -> DataFrame:
    return probabilities.join_country(i.counts(), i.profiles())


@query
def join_moments(i: Inputs) -> DataFrame:
    i.share()
    return probabilities.join_moments(i.means(), i.moments())


@query
def join_ks_country(i: Inputs) -> DataFrame:
    """Scores of two-letter countries only, so that tests of other codes have no country row."""
    i.share()
    return significance.join_ks_country(tested(i), filters.filter_iso2(i.standardized()))


@query
def join_player_counts(i: Inputs) -> DataFrame:
    i.share()
    return significance.join_player_counts(filters.filter_iso2(i.means()), i.player_counts())


@query
def join_global(i: Inputs) -> DataFrame:
    i.share()
    frequent = i.moments().where("mean_p_w > 0.01")
    return significance.join_global(i.means(), frequent)


@query
def join_opening_names(i: Inputs) -> DataFrame:
    return significance.join_opening_names(i.means(), i.openings())


def known_profiles(i: Inputs) -> DataFrame:
    return i.profiles().where("country IS NOT NULL")


def cased(name: F.Column) -> F.Column:
    """Names in two spellings, by the player's number."""
    return F.concat(F.when(name.cast("bigint") % 2 == 0, "P").otherwise("p"), name)


def cased_players(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Players in two spellings, and the known ones in lower case."""
    known = known_profiles(i).withColumn("id", F.concat(F.lit("p"), "id"))
    return counts.distinct_keys(i.counts(), "id").select(cased(F.col("id")).alias("id")), known


@query
def new_players(i: Inputs) -> DataFrame:
    return profiles.new_players(*cased_players(i))


@query
def new_players_by_filter(i: Inputs) -> DataFrame:
    """The same with the known players as a table of files and its stored filter."""
    ids, known = cased_players(i)
    root = fresh_dir(i.spark, "known")
    known.write.parquet(f"{root}/players")
    saved = i.spark.read.parquet(f"{root}/players")
    return profiles.new_players(ids, saved, membership.stored_filter(saved, "id", f"{root}/filters"))


@query
def new_countries(i: Inputs) -> DataFrame:
    codes = counts.distinct_keys(i.profiles(), "country").withColumnRenamed("country", "ISO_A2")
    return geo.new_countries(codes, i.iso())


@query
def attach_player_counts(i: Inputs) -> DataFrame:
    i.share()
    return geo.attach_player_counts(i.means(), filters.filter_iso2(i.player_counts()))


@query
def map_iso3(i: Inputs) -> DataFrame:
    return geo.map_iso3(i.player_counts(), i.iso())


@query
def resolve_country(i: Inputs) -> DataFrame:
    return geo.resolve_country(i.player_counts().withColumnRenamed("country", "ISO_A2"), i.iso())


@query
def country_names(i: Inputs) -> DataFrame:
    return geo.country_names(i.means(), i.iso())


def placed(i: Inputs) -> DataFrame:
    return geo.positions(filters.drop_unresolved(geo.map_iso3(i.standardized(), i.iso()), "country"))


@query
def dense_grid(i: Inputs) -> DataFrame:
    return geo.dense_grid(i.features(), i.openings().select(F.col("id").alias("matched_id")), placed(i))


@query
def feature_player_counts(i: Inputs) -> DataFrame:
    return geo.feature_player_counts(i.features(), geo.map_iso3(i.player_counts(), i.iso()))


@query
def opening_metadata(i: Inputs) -> DataFrame:
    i.share()
    return geo.opening_metadata(i.openings(), i.moments().where("mean_p_w > 0.01"), i.means())


# --- aggregates ------------------------------------------------------------------------------------


@query
def player_openings(i: Inputs) -> DataFrame:
    """Names in two spellings, by color and result: they are counted as written and lower-cased afterwards."""
    won = F.when(F.col("result") == "1-0", "P").otherwise("p")
    games = i.matches().withColumns({c: F.concat(won, F.col(c)) for c in ("white", "black")})
    return counts.player_openings(games)


@query
def player_openings_along_paths(i: Inputs) -> DataFrame:
    deepest = matching.deepest_match(i.games(), i.openings()).withColumn("real_game", F.lit(1))
    return jobs.counts_along_paths(deepest, i.openings())


@query
def merge_counts(i: Inputs) -> DataFrame:
    monthly = i.monthly()
    early, late = monthly.where("month < '1997-01'").drop("month"), monthly.where("month >= '1997-01'")
    return counts.merge_counts([early, late])


@query
def player_totals(i: Inputs) -> DataFrame:
    return counts.player_totals(i.counts())


@query
def country_player_counts(i: Inputs) -> DataFrame:
    return i.player_counts()


@query
def country_player_counts_approx(i: Inputs) -> DataFrame:
    """Sketches per country and first letter of the id, united; the exact number must lie within the stated bounds."""
    i.share()
    parts = probabilities.player_sketches(i.located().withColumn("part", F.substring("id", 1, 1)), ("country", "part"))
    united = probabilities.approx_player_counts(probabilities.united_sketches(parts))
    whole = probabilities.approx_player_counts(probabilities.player_sketches(i.located())).select("country", F.col("num_players").alias("_once"))
    exact = i.player_counts().withColumnRenamed("num_players", "exact")
    inside = F.col("exact").between(F.col("at_least"), F.col("at_most"))
    same = F.abs(F.col("_once") - F.col("num_players")) <= 2 * probabilities.sketch_error() * F.col("exact")
    joined = united.join(whole, "country").join(exact, "country")
    return joined.select("country", F.col("exact").alias("num_players"), inside.alias("within_bounds"), same.alias("as_in_one_pass"))


@query
def global_moments_updated(i: Inputs) -> DataFrame:
    """Moments of all players, from states in which some players were first wrong, then taken out and put in right."""
    players = i.share().counted()
    some = F.col("id").cast("long") % 7 == 0
    wrong = players.where(some).withColumns({m: F.col(m) * 0.5 + 0.25 for m in METRICS})
    states = probabilities.moment_states(players.where(~some).unionByName(wrong))
    states = probabilities.updated_states(states, probabilities.moment_states(wrong), -1)
    return probabilities.moments_of(probabilities.updated_states(states, probabilities.moment_states(players.where(some))))


@query
def country_means(i: Inputs) -> DataFrame:
    return i.means()


@query
def global_moments(i: Inputs) -> DataFrame:
    return i.moments()


@query
def distributions_global(i: Inputs) -> DataFrame:
    return distributions.distributions(i.counted(), ["matched_id"])


@query
def distributions_country(i: Inputs) -> DataFrame:
    return distributions.distributions(i.located(), ["matched_id", "country"])


def array_values(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Arrays as one row per value, so that two engines can be compared."""
    arrays = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_{suffix}").alias("v")) for m in METRICS])
    return df.select(*keys, F.inline(arrays)).select(*keys, "metric", F.explode("v").alias("value"))


@query
def distribution_arrays(i: Inputs) -> DataFrame:
    keys = ["matched_id", "country"]
    return array_values(distributions.distribution_arrays(i.located(), keys), keys, "dist")


@query
def distributions_in_parts(i: Inputs) -> DataFrame:
    """Groups dealt over several rows still hold every value."""
    found = distributions.distribution_arrays(i.counted(), ["matched_id"], "dist_global", parts=4)
    return array_values(found, ["matched_id"], "dist_global")


@query
def distinct_keys(i: Inputs) -> DataFrame:
    return counts.distinct_keys(i.matches(), "matched_id")


@query
def dedupe_known(i: Inputs) -> DataFrame:
    orders = i.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return counts.dedupe_known(orders, "o_custkey", "o_orderkey")


@query
def upsert_latest(i: Inputs) -> DataFrame:
    totals = counts.player_totals(i.counts())
    new = totals.where("total_count_w > 30").withColumn("total_count_b", F.lit(-1).cast("long"))
    return counts.upsert_latest(totals.where("total_count_w <= 40"), new, ["id"])


@query
def num_countries(i: Inputs) -> DataFrame:
    return counts.num_countries(i.iso())


# --- statistics ------------------------------------------------------------------------------------


@query
def player_probabilities(i: Inputs) -> DataFrame:
    return i.players()


@query
def standardize(i: Inputs) -> DataFrame:
    return i.standardized()


@query
def unstandardize(i: Inputs) -> DataFrame:
    scored = i.standardized().withColumnsRenamed({"stand_p_b": "dev_played", "stand_p_won_b": "dev_won"})
    joined = significance.join_global(scored, i.moments())
    return probabilities.unstandardize(joined, "b").select("country", "matched_id", "prob_played", "prob_won")


@query
def ks_two_sample(i: Inputs) -> DataFrame:
    """Players of a known country against the others, per opening and metric."""
    values = distributions.metric_values(i.share().counted(), ["matched_id", "country"])
    known, unknown = values.where("country IS NOT NULL"), values.where("country IS NULL")
    return ks.ks_two_sample(known, unknown, ["matched_id", "metric"])


def subset_tests(i: Inputs) -> DataFrame:
    values = distributions.metric_values(i.counted(), ["matched_id", "country"])
    return ks.ks_subset(values, ["matched_id", "metric"], "country")


@query
def ks_subset(i: Inputs) -> DataFrame:
    return subset_tests(i)


@query
def ks_pvalue(i: Inputs) -> DataFrame:
    p_value = ks.ks_pvalue(F.col("stat"), F.col("n"), F.col("m"), "asymp")
    return subset_tests(i).withColumn("p_value", p_value)


def digits(p_value: F.Column) -> F.Column:
    """Six significant digits, so that small p-values are compared too."""
    return F.when(p_value.isNotNull(), F.format_string("%.5e", p_value))


@query
def ks_pvalue_finite(i: Inputs) -> DataFrame:
    p_value = ks.ks_pvalue(F.col("stat"), F.col("n"), F.col("m"), "finite")
    return subset_tests(i).withColumn("p_value", digits(p_value))


def share_tests(i: Inputs) -> DataFrame:
    """Every country's players against those of the next country by code: their shares of games as white."""
    share = F.col("total_count_w") / (F.col("total_count_w") + F.col("total_count_b"))
    values = i.located().select("id", "country", share.alias("value")).distinct()
    # One row a player, read three times: those of large tables are written once, as each use would count the games anew.
    values = values if small_on_disk(i.table("lineitem")) else written(values, "shares")
    previous = F.lag("country").over(Window.orderBy("country"))
    pairs = values.select("country").distinct().select(F.col("country").alias("_next"), previous.alias("_country")).dropna()
    others = values.join(pairs, F.col("country") == F.col("_next")).select(F.col("_country").alias("country"), "value")
    return ks.ks_two_sample(values, others, ["country"])


@query
def ks_pvalue_exact(i: Inputs) -> DataFrame:
    return ks.with_pvalue(share_tests(i), "exact").withColumn("p_value", digits(F.col("p_value")))


@query
def ks_pvalue_auto(i: Inputs) -> DataFrame:
    """Exact up to samples of 60 players, the finite-sample expansion for the larger ones."""
    return ks.with_pvalue(share_tests(i), "auto", exact_limit=60).withColumn("p_value", digits(F.col("p_value")))


@query
def ks_test_auto(i: Inputs) -> DataFrame:
    """The tests with the p-values that the job takes."""
    return ks.ks_test(i.counted())


def significant_tables(i: Inputs) -> tuple[DataFrame, ...]:
    i.share()
    return tested(i), i.standardized(), i.player_counts(), i.moments(), i.openings()


@query
def significant_deviations(i: Inputs) -> DataFrame:
    return significance.significant_deviations(*significant_tables(i), mode="won", color="b", **LEVELS)


@query
def all_significant_played(i: Inputs) -> DataFrame:
    return significance.all_significant(*significant_tables(i), mode="played", **LEVELS)


@query
def all_significant_won(i: Inputs) -> DataFrame:
    return significance.all_significant(*significant_tables(i), mode="won", **LEVELS)


@query
def bin_position(i: Inputs) -> DataFrame:
    scored = i.standardized()
    placed_ = [numbers.bin_position(F.col(f"stand_p_{s}")).alias(f"pos_{s}") for s in SUFFIXES]
    return scored.select("country", "matched_id", *placed_)


@query
def band(i: Inputs) -> DataFrame:
    return i.moments().select("matched_id", numbers.band(F.col("mean_p_w"), F.col("std_p_w")).alias("b")).select(
        "matched_id", "b.upper", "b.mean", "b.lower"
    )


@query
def opening_profile(i: Inputs) -> DataFrame:
    i.share()
    return significance.opening_profile(geo.country_names(i.means(), i.iso()), i.moments(), i.openings(), "MEDIUM Brand#2")


# --- batches, sorts, unions ---------------------------------------------------------------------------


@query
def request_batches(i: Inputs) -> DataFrame:
    """With a quota of 700 ids a run, so that there are several runs."""
    return profiles.request_batches(i.table("customer").select(F.col("c_name").alias("id")), max_ids=700)


@query
def sort_by_sequence(i: Inputs) -> DataFrame:
    return shaping.sort_by_sequence(i.openings())


@query
def sort_by_deviation(i: Inputs) -> DataFrame:
    scored = i.standardized().select("matched_id", "country", F.col("stand_p_w").alias("dev_played"))
    return shaping.sort_by_deviation(scored)


@query
def sort_by_player(i: Inputs) -> DataFrame:
    return shaping.sort_by_player(i.counts())


@query
def first_n(i: Inputs) -> DataFrame:
    return shaping.first_n(i.table("orders").select("o_orderkey", "o_totalprice"), 100, ["o_totalprice", "o_orderkey"])


@query
def union_all(i: Inputs) -> DataFrame:
    named = i.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    other = i.table("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), "s_suppkey")
    return shaping.union_all([named, other, named])


@query
def union_evolving(i: Inputs) -> DataFrame:
    a = i.table("customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    return shaping.union_evolving(a, i.table("supplier").select(F.col("s_name").alias("name"), "s_acctbal"))


@query
def union_sides(i: Inputs) -> DataFrame:
    games = i.games()
    white, black = (games.select(F.col(c).alias("id"), F.lit(c).alias("side"), "result") for c in ("white", "black"))
    return shaping.union_sides(white, black)


# --- scalar functions -------------------------------------------------------------------------------


@query
def scalar_string(i: Inputs) -> DataFrame:
    events = F.lit("[Event ")
    text = F.concat("p_type", F.lit(": "), "p_name")
    return i.table("part").select(
        "p_partkey",
        F.replace(text, F.lit(" "), F.lit("###")).alias("replaced"),
        F.startswith(text, F.lit("LARGE")).alias("starts"),
        F.contains(text, F.lit("ring")).alias("holds"),
        F.substring_index(text, ":", 1).alias("base"),
        F.lower("p_type").alias("lowered"),
        F.length(text).alias("size"),
        moves.last_mover(text).alias("mover"),
        F.concat_ws(",", "p_brand", "p_type").alias("joined"),
        numbers.thousands(F.floor(F.col("p_retailprice") * 100)).alias("grouped"),
        moves.title_words(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_MODE "), "p_brand")).alias("titled"),
        F.concat_ws("_", "p_brand", F.upper(F.lit("pos_won_w"))).alias("suffixed"),
        F.concat(events, "p_name").alias("marked"),
    )


@query
def scalar_math(i: Inputs) -> DataFrame:
    balance = F.col("c_acctbal")
    return i.table("customer").select(
        "c_custkey",
        F.abs(balance).alias("absolute"),
        F.least(balance, F.lit(100.0)).alias("smaller"),
        F.greatest(balance, F.lit(100.0)).alias("larger"),
        F.rint(balance / 100).cast("int").alias("half_even"),
        F.coalesce(F.when(balance > 0, balance), F.lit(0.0)).alias("filled"),
        ((balance - 4500.0) / (balance + 1e-17)).alias("ratio"),
        F.try_divide(balance, F.col("c_nationkey").cast("double")).alias("share"),
        numbers.percent_one_decimal(balance / 10000).alias("percent"),
    )


@query
def scalar_date(i: Inputs) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    start = F.to_date(month, "yyyy-MM")
    return i.table("orders").select(
        "o_orderkey",
        month.alias("month"),
        F.date_format(F.add_months(start, 5), "yyyy-MM").alias("later"),
        F.months_between(start, F.to_date(F.lit("1992-01-01"))).cast("int").alias("since"),
    )


@query
def scalar_map_json(i: Inputs) -> DataFrame:
    entries = F.array(
        F.struct(F.col("c_mktsegment").alias("k"), F.col("c_nationkey").alias("v")),
        F.struct(F.lit("other").alias("k"), F.lit(-1).alias("v")),
    )
    named = F.map_from_entries(entries)
    found = F.coalesce(F.try_element_at(named, F.lit("BUILDING")), F.lit(0))
    document = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct("c_nationkey").alias("place")))
    return i.table("customer").select(
        "c_custkey",
        found.alias("looked_up"),
        F.array_join(F.slice(F.split("c_name", "0"), 1, 2), "-").alias("sliced"),
        document.alias("document"),
    )


# --- map documents ------------------------------------------------------------------------------------


def plain_features(i: Inputs) -> DataFrame:
    """The map's codes as features with a name, a point and members that GeoJSON allows besides."""
    return i.features().select(
        F.lit("Feature").alias("type"),
        F.map_from_arrays(
            F.array(F.lit("ISO_A3"), F.lit("ADMIN")),
            F.array(F.col("ISO_A3").cast("variant"), F.lower("ISO_A3").cast("variant")),
        ).alias("properties"),
        F.parse_json(F.concat(F.lit('{"type":"Point","coordinates":[0.5,'), F.length("ISO_A3"), F.lit("]}"))).alias("geometry"),
        F.map_from_arrays(
            F.array(F.lit("id"), F.lit("bbox")),
            F.array(F.concat(F.lit("f"), "ISO_A3").cast("variant"), F.parse_json(F.lit("[0,1]"))),
        ).alias("members"),
    )


def collection_members(i: Inputs) -> DataFrame:
    return i.spark.range(1).select(
        F.map_from_arrays(
            F.array(F.lit("name"), F.lit("crs")), F.array(F.lit("countries").cast("variant"), F.parse_json(F.lit('{"type":"name"}')))
        ).alias("members")
    )


def feature_values(df: DataFrame) -> DataFrame:
    code = features.property_text(df, "ISO_A3").alias("ISO_A3")
    return df.select(code, F.explode("properties").alias("key", "value")).select(
        "ISO_A3", "key", F.col("value").cast("string").alias("value")
    )


def member_values(df: DataFrame, code: F.Column, prefix: str) -> DataFrame:
    found = df.select(code.alias("ISO_A3"), F.explode("members").alias("key", "value"))
    return found.select("ISO_A3", F.concat(F.lit(prefix), "key").alias("key"), F.to_json("value").alias("value"))


@query
def read_features(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "features")
    features.write_features(plain_features(i), path, document=True, collection=collection_members(i))
    read = features.read_features(i.spark, path)
    members = member_values(read, features.property_text(read, "ISO_A3"), "member ")
    collection = member_values(features.read_collection(i.spark, path), F.lit(None).cast("string"), "collection ")
    return feature_values(read).unionByName(members).unionByName(collection)


@query
def write_features(i: Inputs) -> DataFrame:
    path = fresh_dir(i.spark, "features")
    features.write_features(plain_features(i), path)
    read = features.read_features(i.spark, path, lines=True)
    code = F.try_element_at("members", F.lit("id")).cast("string").alias("id")
    return read.select(features.property_text(read, "ADMIN").alias("admin"), F.to_json("geometry").alias("geometry"), code)


@query
def feature_enrichment(i: Inputs) -> DataFrame:
    enriched = geo.feature_enrichment(i.standardized(), i.player_counts(), i.iso(), plain_features(i))
    code = features.property_text(enriched, "ISO_A3")
    values = feature_values(enriched).where("key <> 'ADMIN' AND key <> 'ISO_A3'").withColumn("value", F.col("value").cast("double"))
    kept = member_values(enriched, code, "member ").where("key = 'member bbox'").withColumn("value", F.lit(1.0))
    return values.unionByName(kept)


def written_metadata(i: Inputs, document: bool) -> str:
    """Metadata written over earlier ones, of which a member is to be kept and a number to be replaced."""
    path = fresh_dir(i.spark, "metadata")
    i.share()
    described = geo.opening_metadata(i.openings(), i.moments(), i.means())
    earlier = i.spark.range(1).select(F.parse_json(F.lit('{"source":"kept","num_countries":-1}')).cast("variant").alias("d"))
    earlier = earlier.select(F.try_variant_get("d", "$", features.MEMBERS).alias("members"))
    features.write_metadata(described, counts.num_countries(i.iso()), numbers.bin_counts(), path, document, earlier)
    return path


@query
def write_metadata(i: Inputs) -> DataFrame:
    path = written_metadata(i, document=False)
    totals = features.read_metadata(i.spark, path).drop("members")
    return features.read_metadata_openings(i.spark, path).select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


@query
def read_metadata(i: Inputs) -> DataFrame:
    path = written_metadata(i, document=True)
    found = features.read_metadata(i.spark, path, document=True)
    known = features.read_metadata_openings(i.spark, path, document=True).agg(F.count("*").cast("int").alias("n"))
    source = F.try_element_at("members", F.lit("source")).cast("string").alias("source")
    return found.select(*features.TOTALS, known.scalar().alias("num_openings"), source)


# --- jobs ------------------------------------------------------------------------------------------


@query
def games(i: Inputs) -> DataFrame:
    return jobs.games_from_records(written_records(i), i.openings())


def written_months(i: Inputs, root: str) -> tuple[str, str]:
    """The players' table of every month, each a stage of its own; gives the first and the last month."""
    path = f"{root}/written"
    bounds = write_monthly(i, path)
    for month in stages.month_range(*bounds):
        if path_exists(i.spark, f"{path}/month={month}"):
            move_path(i.spark, f"{path}/month={month}", stages.stage_path(root, "players", month))
    return bounds


@query
def merge_months(i: Inputs) -> DataFrame:
    root = fresh_dir(i.spark, "months")
    i.spark.range(0).write.parquet(stages.stage_path(root, "players", "none"))
    return i.spark.read.parquet(jobs.run_merge_months(i.spark, root, *written_months(i, root)))


@query
def month_ledger(i: Inputs) -> DataFrame:
    """Months added to a ledger, those of 1994 with rows missing at first, and two months withdrawn at the end."""
    root = fresh_dir(i.spark, "ledger")
    path = f"{root}/months"
    bounds = write_monthly(i, path)
    named = stages.month_range(*bounds)
    counted, late = stages.read_months(i.spark, path, *bounds), [m for m in named if m.startswith("1994")]
    missing = (F.col("month").isin(late)) & (F.col("count_w") > 0)
    ledger.put_months(i.spark, f"{root}/ledger", counted.where(~missing), named, buckets=8)
    ledger.put_months(i.spark, f"{root}/ledger", counted.where(F.col("month").isin(late)), late)
    ledger.withdraw_months(i.spark, f"{root}/ledger", ["1995-03", "1996-12"])
    return ledger.state(i.spark, f"{root}/ledger")


@query
def new_player_batches(i: Inputs) -> DataFrame:
    return profiles.new_player_batches(*cased_players(i), size=20, per_period=3)


@query
def merge_profiles(i: Inputs) -> DataFrame:
    root = fresh_dir(i.spark, "profiles")
    stages.write_stage(known_profiles(i), root, "players", "known_players", compression="gzip")
    profile = F.struct("country", F.lit("new").alias("source"))
    found = i.profiles().where("country IS NULL").select(F.concat(F.lit("P"), "id").alias("id"), profile.alias("profile"))
    jobs.run_merge_profiles(i.spark, root, found)
    return stages.read_stage(i.spark, root, "players", "known_players")


@query
def country_probabilities(i: Inputs) -> DataFrame:
    return jobs.country_probabilities(i.players())["countries"]


@query
def ks_test(i: Inputs) -> DataFrame:
    return ks.ks_test(i.counted(), "asymp")


@query
def known_countries(i: Inputs) -> DataFrame:
    known = i.iso().where("ISO_A2 < 'KX'").withColumn("place_id", F.lit("seen"))
    return geo.known_countries(i.means(), i.iso(), known)
