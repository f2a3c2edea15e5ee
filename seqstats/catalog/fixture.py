"""The pipeline's inputs derived from the given star-schema tables, whole tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.operators import counts, probabilities
from seqstats.operators.filters import filter_has_country, filter_min_games
from seqstats.operators.matching import match_prefixes
from seqstats.session import small_on_disk, written
from seqstats.sources.records import ordered_sequence


# Columns of the given tables, so that no scan has to look them up first.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


class Inputs:
    """Inputs and intermediate tables of the pipeline over one data folder, all lazy but for ``share``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._matches: DataFrame | None = None
        self._counted: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def games(self) -> DataFrame:
        """Order lines as games of a customer against another one, the part as the moves."""
        customers = self.table("customer").agg(F.count("*"))
        columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
        # Lines and orders are both large at scale: the same plan at every size, and as many tasks as shuffle partitions.
        orders = self.table("orders").hint("merge")
        lines = self.table("lineitem").select(*columns).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        base = F.when(F.col("l_linestatus") == "O", F.concat("p_type", F.lit(": "), "p_name")).otherwise(
            F.concat("p_brand", F.lit(": "), "p_type")
        )
        return lines.select(
            F.col("o_custkey").cast("string").alias("white"),
            ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % customers.scalar()).cast("string").alias("black"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", base).alias("original_name"),
            F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("moves"),
            F.when(F.col("l_returnflag") == "R", "1-0")
            .when(F.col("l_returnflag") == "A", "0-1")
            .otherwise("1/2-1/2")
            .alias("result"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        )

    def openings(self) -> DataFrame:
        """Part types, and types with brand, as named prefixes; some are left unnamed."""
        part = self.table("part")
        short = part.where("p_type <> 'PROMO'").select(
            F.col("p_type").alias("moves"), F.col("p_type").alias("name"), F.concat(F.lit("1. "), "p_type").alias("pgn")
        )
        long = part.where("p_brand <> 'Brand#1'").select(
            F.concat_ws(" ", "p_type", "p_brand").alias("moves"),
            F.concat_ws(": ", "p_type", "p_brand").alias("name"),
            F.concat(F.lit("1. "), F.concat_ws(" ", "p_type", "p_brand")).alias("pgn"),
        )
        eco = F.concat(F.substring("moves", 1, 1), F.lit("00")).alias("eco")
        both = short.unionByName(long).distinct()
        return both.select(F.col("moves").alias("id"), eco, "name", "pgn", F.col("moves").alias("uci"), "moves")

    def profiles(self) -> DataFrame:
        """Customers' countries; some have none and some a code of a part of the country."""
        code = F.concat(F.chr(F.col("n_nationkey") + 65), F.lit("X"))
        country = (
            F.when(F.col("c_acctbal") < 0, None)
            .when((F.col("c_mktsegment") == "MACHINERY") & (F.col("n_regionkey") == 0), F.concat(code, F.lit("-N")))
            .otherwise(code)
        )
        joined = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(F.col("c_custkey").cast("string").alias("id"), country.alias("country"))

    def iso(self) -> DataFrame:
        code = F.chr(F.col("n_nationkey") + 65)
        return self.table("nation").select(
            F.concat(code, F.lit("X")).alias("ISO_A2"),
            F.concat(code, F.lit("XX")).alias("ISO_A3"),
            F.col("n_name").alias("country"),
        )

    def features(self) -> DataFrame:
        """Codes on the map: every nation's, and every region's, which no player has."""
        regions = self.table("region").select(F.upper(F.substring("r_name", 1, 2)).alias("ISO_A3")).distinct()
        return self.iso().select("ISO_A3").unionByName(regions)

    def matches(self) -> DataFrame:
        if self._matches is None:
            self._matches = match_prefixes(self.games(), self.openings())
        return self._matches

    def counts(self) -> DataFrame:
        return counts.player_openings(self.matches())

    def monthly(self, parts: int | None = None) -> DataFrame:
        return counts.player_openings(self.matches(), ("month",), parts)

    def players(self) -> DataFrame:
        return probabilities.player_probabilities(self.counts(), self.profiles())

    def counted(self) -> DataFrame:
        return filter_min_games(self.players()) if self._counted is None else self._counted

    def share(self) -> Inputs:
        """For a query that reads the counted players several times: those of large tables are written once.

        Each use reads other columns, so that Spark would count and shuffle the games for each of them.
        """
        if self._counted is None and not small_on_disk(self.table("lineitem")):
            self._counted = written(self.counted(), "counted")
        return self

    def located(self) -> DataFrame:
        return filter_has_country(self.counted())

    def moments(self) -> DataFrame:
        return probabilities.global_moments(self.counted())

    def means(self) -> DataFrame:
        return probabilities.country_means(self.located())

    def standardized(self) -> DataFrame:
        self.share()
        return probabilities.standardize(self.means(), self.moments())

    def player_counts(self) -> DataFrame:
        return probabilities.country_player_counts(self.located())

    def sequences(self) -> DataFrame:
        """Events by user and day as sequences of up to ten event types."""
        events = self.table("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        return ordered_sequence(events, ["user_id", "day"], ["ts", "event_id"], "event_type")


# Added before rounding: moves exact halves of the last place off the edge, where the last
# bit of a sum, and so the order of its terms, would decide the digit.
NUDGE = 1e-9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so that two engines can be compared."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(F.col(c) + NUDGE, places).alias(c) if c in doubles else F.col(c) for c in df.columns])
