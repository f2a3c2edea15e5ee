"""Known players and the batches in which new ones are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstats.operators.counts import distinct_keys
from seqstats.operators.filters import filter_valid_id
from seqstats.operators.membership import anti_join
from seqstats.session import written


def new_players(ids: DataFrame, known: DataFrame, seen: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Ids not among the known ones, whatever their case.

    ``seen``: the filter of the known ids and its number of blocks (``membership.stored_filter``). Ids that it rejects are
    new without a join, so a very large known table meets only those that it lets through.
    """
    if seen is not None:
        return anti_join(ids, F.lower("id"), known, "id", *seen)
    seen = known.select(F.col("id").alias("_known"))
    return ids.join(seen, F.lower("id") == F.col("_known"), "left_anti")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """The rows with ``rank`` from 0 in the order of ``key``, counted in ranges of it.

    The ranges are written once. A row's rank is its place inside its range plus the sizes of the ranges below, so only
    those sizes, one row per range, come together.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_size"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return cut.withColumn("_place", place).join(sizes, "_range").select(
        *df.columns, (F.col("_below") + F.col("_place")).alias("rank")
    )


# Ids in a batch, batches in a period, seconds of a period and ids a run may look up.
BATCH_IDS, PERIOD_BATCHES, PERIOD_SECONDS, RUN_IDS = 300, 26, 600, 120_000


def request_batches(
    ids: DataFrame, size: int = BATCH_IDS, per_period: int = PERIOD_BATCHES, period: int = PERIOD_SECONDS,
    max_ids: int = RUN_IDS,
) -> DataFrame:
    """Schedule of all ids: batches of ``size`` ids, ``per_period`` of them starting each period.

    The lookup's quota is ``max_ids`` a run: later ids are in ``run`` 1, 2, ..., whose batches and periods count from 0.
    """
    run = F.floor(F.col("rank") / max_ids)
    batch = F.floor((F.col("rank") % max_ids) / size)
    slot = F.floor(F.col("batch_no") / per_period)
    return (
        ranked(ids.where("id IS NOT NULL").select("id"), "id")
        .groupBy(run.alias("run"), batch.alias("batch_no"))
        .agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
        .select("run", "batch_no", slot.alias("slot"), (slot * period).alias("start_offset_s"), "ids")
    )


def new_player_batches(
    players: DataFrame, known: DataFrame, seen: tuple[DataFrame, int] | None = None, **limits: int
) -> DataFrame:
    """Batches of all players without a profile."""
    return request_batches(filter_valid_id(new_players(distinct_keys(players, "id"), known, seen)), **limits)
