"""Counts over months as a state that is kept up: a month is added, replaced or withdrawn without reading the others.

The state holds each player's sums per opening and the number of months behind them; it is bucketed by ``id``. A change is
what the month's new rows add minus what its old rows had added. Only this difference is shuffled, to the state's buckets; the
state itself is read bucket by bucket, joined and written as the next version, each bucket by the task that read it. The
ledger, a commit log, names the state, and for each month the table its rows are in, so that they can be taken back later.

New rows are shuffled once, by ``id`` to parts that lie within the state's buckets, and their months' tables are written in
these parts: where no old rows go, the difference is worked out part by part, and a first state is written as it lies.

Players without a name are left out, as all later steps do. A month with no rows counts as added. Changes are idempotent:
adding a month twice with the same rows changes nothing, so a run that stopped is repeated as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.operators.counts import COUNTS
from seqstats.session import path_bytes
from seqstats.sources import commits

BUCKETS = 64
# Bytes of the first months' files for one bucket; of more, the state has as many buckets as there are parts.
BUCKET_BYTES = 32 * 1024 * 1024
KEYS = ["id", "matched_id"]
ROW = ", ".join(["id STRING", "matched_id STRING", *[f"{c} BIGINT" for c in COUNTS]])
STATE = f"{ROW}, months BIGINT"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _bucketed(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """A folder read with its buckets. The table that tells Spark about them has a name of its own and goes at once."""
    name = f"ledger_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    name = f"ledger_{uuid.uuid4().hex}"
    # A task has rows of one bucket only, and so one writer: they need not be sorted by bucket first.
    with _setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        df.write.bucketBy(buckets, "id").format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


@contextmanager
def _month_table(put: DataFrame, path: str, parts: int) -> Iterator[DataFrame]:
    """The sums of a change per month, written to ``path`` with a folder for each, in ``parts`` by ``id``, and read so."""
    spark, name = put.sparkSession, f"ledger_{uuid.uuid4().hex}"
    kept = put.where(F.col("id").isNotNull() & F.col("matched_id").isNotNull())
    summed = kept.repartition(parts, "id").groupBy("month", *KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    writer = summed.write.partitionBy("month").bucketBy(parts, "id").sortBy(*KEYS)
    try:
        writer.format("parquet").option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Sums per player and opening over all months of the ledger, with the number of months; bucketed by ``id``."""
    _, found = commits.read_commit(spark, root, version)
    if not found.get("state"):
        return spark.createDataFrame([], STATE)
    return _bucketed(spark, f"{root}/{found['state']}", STATE, found["buckets"])


def months(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    return sorted(commits.read_commit(spark, root, version)[1].get("months", {}))


def month_rows(spark: SparkSession, root: str, month: str, version: int | None = None) -> DataFrame:
    """The rows that a month has added."""
    table = commits.read_commit(spark, root, version)[1]["months"][month]
    return spark.read.schema(ROW).parquet(f"{root}/{table}/month={month}")


def difference(new: DataFrame | None, old: list[DataFrame]) -> DataFrame:
    """What a change adds per player and opening: new rows count, old rows count against."""
    signed = [df.select(*KEYS, *[(sign * F.col(c)).alias(c) for c in COUNTS], (sign * F.col("months")).alias("months"))
              for sign, df in [*((1, x) for x in [new] if x is not None), *((-1, x) for x in old)]]
    every = signed[0]
    for df in signed[1:]:
        every = every.unionByName(df)
    return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in [*COUNTS, "months"]]).where(
        " OR ".join(f"{c} <> 0" for c in [*COUNTS, "months"])
    )


def changed(before: DataFrame, change: DataFrame, buckets: int | None = None) -> DataFrame:
    """The state after a change; openings that no month speaks of any more go.

    The change is dealt to the state's ``buckets``: of fewer buckets than shuffle partitions Spark would shuffle the state.
    """
    change = change if buckets is None else change.repartition(buckets, "id")
    change = change.select(*[F.col(c).alias(f"_{c}") for c in change.columns])
    same = (F.col("id") == F.col("_id")) & (F.col("matched_id") == F.col("_matched_id"))
    joined = before.join(change.hint("merge"), same, "full_outer")
    sums = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in [*COUNTS, "months"]]
    return joined.select(F.coalesce("id", "_id").alias("id"), F.coalesce("matched_id", "_matched_id").alias("matched_id"), *sums).where("months > 0")


def _apply(spark: SparkSession, root: str, put: DataFrame | None, named: list[str], buckets: int) -> int:
    """One change of all ``named`` months: their old rows go, those of ``put`` come."""
    version, found = commits.read_commit(spark, root)
    table, known = f"months-{uuid.uuid4().hex}", dict(found.get("months", {}))
    old = [month_rows(spark, root, m, version).withColumn("months", F.lit(1)) for m in named if known.get(m)]
    for month in named:
        known.pop(month, None)
    buckets, after, new = found.get("buckets", buckets), found.get("state"), None
    parts = buckets * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    with ExitStack() as tables:
        if put is not None:
            rows = tables.enter_context(_month_table(put, f"{root}/{table}", parts))
            written = {x.removeprefix("month=") for x in commits.names(spark, f"{root}/{table}") if x.startswith("month=")}
            if stray := written - set(named):
                raise ValueError(f"rows of months that are not named: {', '.join(sorted(stray))}")
            known |= {m: table if m in written else None for m in named}
            if written:
                new = rows.withColumn("months", F.lit(1))
            if after is None and path_bytes(spark, f"{root}/{table}") > buckets * BUCKET_BYTES:
                buckets = parts
        if new is not None or old:
            change = difference(new, old)
            after = f"state-{uuid.uuid4().hex}"
            with _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
                if found.get("state"):
                    change = changed(state(spark, root, version), change, None if parts == buckets and not old else buckets)
                _write_bucketed(change, f"{root}/{after}", buckets)
    return commits.commit(spark, root, {"buckets": buckets, "state": after, "months": known}, version)


def put_months(spark: SparkSession, root: str, counts: DataFrame, named: list[str], buckets: int = BUCKETS) -> int:
    """Add or replace the ``named`` months by the rows of ``counts`` (with a column ``month``); gives the version.

    ``buckets`` is fixed by the first change, a large one raises it to its parts: as many tasks read and write the state.
    """
    return _apply(spark, root, counts, named, buckets)


def withdraw_months(spark: SparkSession, root: str, named: list[str]) -> int:
    """Take months back; those that the ledger does not have are passed over."""
    return _apply(spark, root, None, named, BUCKETS)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what only older versions than the last ``keep`` use, and what stopped runs have left."""
    used = set()
    for version in commits.versions(spark, root)[-keep:]:
        _, found = commits.read_commit(spark, root, version)
        used |= {found.get("state"), *found.get("months", {}).values()}
    return commits.vacuum(spark, root, used, keep)
