"""Countries, map features and the metadata of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.functions.numbers import bin_position
from seqstats.operators.counts import distinct_keys
from seqstats.operators.filters import drop_unresolved
from seqstats.operators.shaping import METRICS, SUFFIXES, union_evolving
from seqstats.sources.features import MOMENTS, property_text

CELLS = [c for s in SUFFIXES for c in (f"pos_{s}", f"p_{s}")]


def resolve_country(df: DataFrame, iso: DataFrame) -> DataFrame:
    """Add name and three-letter code of ``ISO_A2``, NULL if it is no country."""
    return df.join(iso.select("ISO_A2", "country", "ISO_A3"), "ISO_A2", "left")


def new_countries(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known.select("ISO_A2"), "ISO_A2", "left_anti")


def known_countries(country: DataFrame, iso: DataFrame, known: DataFrame) -> DataFrame:
    """The known countries plus those that occur in ``country`` and can be resolved."""
    codes = distinct_keys(country, "country").withColumnRenamed("country", "ISO_A2")
    return union_evolving(known, new_countries(drop_unresolved(resolve_country(codes, iso), "country"), known))


def country_names(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of known countries, with the country's name for its code."""
    names = known.select(F.col("ISO_A2").alias("_code"), F.col("country").alias("_name"))
    joined = df.join(names, F.col("country") == F.col("_code"))
    return joined.withColumn("country", F.col("_name")).drop("_code", "_name")


def attach_player_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    return df.join(counts, "country", "left")


def map_iso3(df: DataFrame, known: DataFrame) -> DataFrame:
    """Replace the two-letter ``country`` by its three-letter code, NULL if unknown.

    The former code is kept as ``iso_a2``.
    """
    codes = known.select(F.col("ISO_A2").alias("iso_a2"), F.col("ISO_A3").alias("_iso3"))
    renamed = df.withColumnRenamed("country", "iso_a2")
    columns = [F.col("_iso3").alias("country") if c == "country" else F.col(c) for c in df.columns]
    return renamed.join(codes, "iso_a2", "left").select(*columns, "iso_a2")


def positions(df: DataFrame) -> DataFrame:
    """Color positions of the standard scores; missing values become 0 afterwards."""
    placed = df.withColumns({f"pos_{s}": bin_position(F.col(f"stand_p_{s}")) for s in SUFFIXES})
    return placed.fillna(0, METRICS)


def cells_of(data: DataFrame) -> DataFrame:
    """Positions and probabilities by feature code and opening, only where there are data.

    Two codes for one feature: the one with the greater two-letter code counts.
    """
    last = F.max_by(F.struct(*CELLS), "iso_a2").alias("_cell")
    cells = data.groupBy(F.col("country").alias("ISO_A3"), "matched_id").agg(last)
    return cells.select("ISO_A3", "matched_id", *[F.col("_cell")[c].alias(c) for c in CELLS])


def dense_grid(features: DataFrame, openings: DataFrame, data: DataFrame) -> DataFrame:
    """Positions and probabilities for every feature and opening, 0 where there are none.

    For consumers that want a row for every cell; the map itself stores the cells with data only. The openings, which the
    dictionary bounds, are one array that every feature is exploded by.
    """
    every = openings.agg(F.collect_set("matched_id").alias("all")).scalar()
    grid = features.select("ISO_A3").distinct().withColumn("_all", every).select("ISO_A3", F.explode("_all").alias("matched_id"))
    return grid.join(cells_of(data), ["ISO_A3", "matched_id"], "left").fillna(0, CELLS)


def feature_player_counts(features: DataFrame, counts: DataFrame) -> DataFrame:
    """Features (``ISO_A3``) with their number of players, 0 if there are none."""
    last = F.max_by("num_players", "iso_a2").alias("num_players")
    by_code = counts.groupBy(F.col("country").alias("ISO_A3")).agg(last)
    return features.select("ISO_A3").join(by_code, "ISO_A3", "left").fillna(0, ["num_players"])


LABELS = [(f"POS_{s.upper()}", f"pos_{s}", True) if whole else (s.upper(), f"p_{s}", False) for s in SUFFIXES for whole in (True, False)]


def cell_properties(cells: DataFrame) -> DataFrame:
    """Cells as feature properties: ``ISO_A3``, ``key``, ``value`` and whether it is whole."""
    entries = []
    for label, cell, whole in LABELS:
        key, value = F.concat_ws("_", "matched_id", F.lit(label)), F.col(cell).cast("double")
        entries.append(F.struct(key.alias("key"), value.alias("value"), F.lit(whole).alias("whole")))
    return cells.select("ISO_A3", F.inline(F.array(*entries)))


def feature_enrichment(
    country: DataFrame, counts: DataFrame, known: DataFrame, features: DataFrame
) -> DataFrame:
    """Map features with player count, positions and probabilities added to their properties.

    Rows are made for cells with data only. A feature's properties are one map, bounded by the number of openings; the
    openings it has no data for are filled in there with 0.
    """
    data = drop_unresolved(positions(map_iso3(attach_player_counts(country, counts), known)), "country")
    players = drop_unresolved(map_iso3(counts, known), "country")
    coded = features.withColumn("ISO_A3", property_text(features, "ISO_A3"))
    codes = coded.select("ISO_A3").distinct()
    typed = F.when(F.col("whole"), F.col("value").cast("int").cast("variant")).otherwise(F.col("value").cast("variant"))
    folded = (
        cell_properties(cells_of(data))
        .groupBy("ISO_A3")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", typed))).alias("_cells"))
    )
    # All keys that any feature has: read from the folded cells, so that nothing is worked out twice.
    every = folded.select(F.explode(F.map_keys("_cells")).alias("key")).distinct().agg(F.array_sort(F.collect_set("key")).alias("all")).scalar()
    none = F.create_map().cast("map<string,variant>")
    joined = coded.join(folded, "ISO_A3", "left").join(feature_player_counts(codes, players), "ISO_A3", "left")
    joined = joined.withColumn("_cells", F.coalesce("_cells", none)).withColumn("_all", every)
    missing = F.array_except("_all", F.map_keys("_cells"))
    zero = F.lit(0).cast("variant")
    count = F.map_from_arrays(F.array(F.lit("PLAYER_COUNT")), F.array(F.col("num_players").cast("variant")))
    filled = joined.withColumn("_missing", missing).withColumn(
        "_added", F.map_concat("_cells", F.map_from_arrays("_missing", F.transform("_missing", lambda k: zero)), count)
    )
    # Values of an earlier enrichment give way to the new ones. What is left to look up is the map's own properties.
    kept = filled.withColumn("_kept", F.array_except(F.map_keys("properties"), F.map_keys("_added")))
    own = F.map_from_arrays("_kept", F.transform("_kept", lambda k: F.try_element_at("properties", k)))
    rest = ["members"] if "members" in features.columns else []
    return kept.select("type", F.map_concat(own, "_added").alias("properties"), "geometry", *rest)


def opening_metadata(openings: DataFrame, moments: DataFrame, data: DataFrame) -> DataFrame:
    """Name, moves and global moments of every opening that occurs in ``data``."""
    named = openings.select(F.col("id").alias("matched_id"), "name", "pgn")
    return (
        distinct_keys(data, "matched_id")
        .join(named, "matched_id", "left")
        .join(moments, "matched_id", "left")
        .select("matched_id", "name", "pgn", *MOMENTS)
    )
