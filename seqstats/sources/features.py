"""Map features (GeoJSON) and the metadata of the map, as lines or as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "map<string,variant>"
MOMENTS = [f"{m}_{p}" for p in ("p_w", "p_b", "p_won_w", "p_won_b") for m in ("mean", "std")]
OPENING = "matched_id STRING, name STRING, pgn STRING, " + ", ".join(f"{m} DOUBLE" for m in MOMENTS)
# The members of the metadata document that this library writes.
TOTALS = ("positive_positions", "negative_positions", "num_countries")


def _member(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _others(value: Column, *known: str) -> Column:
    """The members of a JSON object besides the known ones."""
    return F.map_filter(F.try_variant_get(value, "$", MEMBERS), lambda k, v: ~k.isin(*known))


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of a FeatureCollection document, or of files with one feature per line.

    A feature keeps its properties by name, each of its own type, and further members (``id``, ``bbox``, ...) in ``members``.
    """
    if lines:
        found = spark.read.option("singleVariantColumn", "f").json(path)
    else:
        document = spark.read.schema("features ARRAY<VARIANT>").option("multiLine", True).json(path)
        found = document.select(F.explode("features").alias("f"))
    f = F.col("f")
    return found.select(
        _member(f, "type", "string").alias("type"),
        _member(f, "properties", MEMBERS).alias("properties"),
        _member(f, "geometry", "variant").alias("geometry"),
        _others(f, "type", "properties", "geometry").alias("members"),
    )


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """One row: the ``members`` of a FeatureCollection document besides its type and features."""
    document = spark.read.option("singleVariantColumn", "d").option("multiLine", True).json(path)
    return document.select(_others(F.col("d"), "type", "features").alias("members"))


def _inner(json: Column) -> Column:
    """The text between an object's braces."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def _joined(*texts: Column) -> Column:
    """One object of the members in several objects' texts, empty ones left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(t != "", t) for t in texts]), F.lit("}"))


def feature_lines(df: DataFrame) -> DataFrame:
    members = _inner(F.to_json("members")) if "members" in df.columns else F.lit("")
    return df.select(_joined(_inner(F.to_json(F.struct("type", "properties", "geometry"))), members).alias("value"))


def write_features(df: DataFrame, path: str, document: bool = False, collection: DataFrame | None = None) -> None:
    """One feature per line; or, for maps that fit a row, all of them in one FeatureCollection with the given members."""
    line = feature_lines(df)
    if not document:
        line.write.mode("overwrite").text(path)
        return
    members = _inner(F.to_json(collection.scalar())) if collection is not None else F.lit("")
    features = F.concat(F.lit('"features":['), F.array_join(F.collect_list("value"), ","), F.lit("]"))
    together = line.agg(features.alias("features"))
    together.select(_joined(F.lit('"type":"FeatureCollection"'), members, F.col("features"))).write.mode("overwrite").text(path)


def property_text(df: DataFrame, name: str) -> Column:
    """A property as text, NULL if the feature lacks it."""
    return F.try_element_at(df["properties"], F.lit(name)).cast("string")


def write_metadata(
    openings: DataFrame, num_countries: DataFrame, positions: tuple[int, int], path: str, document: bool = False,
    previous: DataFrame | None = None,
) -> None:
    """Scale steps, number of countries and the openings.

    As lines: ``openings`` below ``path`` has an opening per line, ``totals`` the rest in one line. Or, for dictionaries that
    fit a row, one document with the openings by id. ``previous`` is one row of ``members`` (``read_members``): those that
    are not written anew are kept.
    """
    totals = F.struct(
        F.lit(positions[0]).alias(TOTALS[0]), F.lit(positions[1]).alias(TOTALS[1]), num_countries.scalar().alias(TOTALS[2])
    )
    kept = F.lit("")
    if previous is not None:
        rest = previous.select(F.map_filter("members", lambda k, v: ~k.isin(*TOTALS, "openings")).alias("members"))
        kept = _inner(F.to_json(rest.scalar()))
    if document:
        entry = F.struct("name", "pgn", *MOMENTS)
        together = F.map_from_entries(F.collect_list(F.struct("matched_id", entry))).alias("openings")
        found = openings.agg(together).select(_joined(_inner(F.to_json(totals)), _inner(F.to_json(F.struct("openings"))), kept))
        found.write.mode("overwrite").text(path)
        return
    openings.select(F.to_json(F.struct("matched_id", "name", "pgn", *MOMENTS))).write.mode("overwrite").text(f"{path}/openings")
    one = openings.sparkSession.range(1).select(_joined(_inner(F.to_json(totals)), kept))
    one.write.mode("overwrite").text(f"{path}/totals")


def read_members(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """One row: all ``members`` of a metadata document, or of the line form's totals."""
    file = path if document else f"{path}/totals"
    found = spark.read.option("singleVariantColumn", "d").option("multiLine", True).json(file)
    return found.select(F.try_variant_get("d", "$", MEMBERS).alias("members"))


def read_metadata(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """One row: scale steps, number of countries and the further ``members``."""
    found = read_members(spark, path, document)
    own = [F.try_element_at("members", F.lit(t)).cast("bigint" if t == "num_countries" else "int").alias(t) for t in TOTALS]
    return found.select(*own, F.map_filter("members", lambda k, v: ~k.isin(*TOTALS, "openings")).alias("members"))


def read_metadata_openings(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """The metadata's openings, one row each."""
    if not document:
        return spark.read.schema(OPENING).json(f"{path}/openings")
    entry = OPENING.removeprefix("matched_id STRING, ")
    found = spark.read.schema(f"openings MAP<STRING, STRUCT<{entry.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>")
    return found.option("multiLine", True).json(path).select(F.explode("openings").alias("matched_id", "o")).select("matched_id", "o.*")
