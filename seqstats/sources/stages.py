"""Named stage tables, known-entity tables and checkpointed batches."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqstats.operators.counts import dedupe_known
from seqstats.session import delete_path, move_path, path_exists, rename_path

# Folder of each stage below the data folder.
STAGES = {
    "games": "output/games",
    "players": "output/players",
    "countries": "output/countries",
    "openings": "openings",
    "distributions": "analysis/distributions",
    "ks_test": "analysis/ks_test",
    "significant": "analysis/significant_openings",
}


def stage_name(name: str, suffix: str = "") -> str:
    """``2022-07.parquet`` with suffix ``prob`` is ``2022-07_prob.parquet``."""
    stem = name.removesuffix(".parquet")
    return f"{stem}_{suffix}.parquet" if suffix else f"{stem}.parquet"


def stage_path(root: str, stage: str, name: str, suffix: str = "") -> str:
    return f"{root.rstrip('/')}/{STAGES[stage]}/{stage_name(name, suffix)}"


def read_stage(spark: SparkSession, root: str, stage: str, name: str, suffix: str = "") -> DataFrame:
    return spark.read.parquet(stage_path(root, stage, name, suffix))


def write_stage(
    df: DataFrame, root: str, stage: str, name: str, suffix: str = "", compression: str | None = None
) -> str:
    path = stage_path(root, stage, name, suffix)
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return path


def read_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def month_range(start: str, end: str | None = None) -> list[str]:
    """Every month ``YYYY-MM`` from ``start`` to ``end`` inclusive (default: this month)."""
    first, last = (_month_number(m) for m in (start, end or date.today().strftime("%Y-%m")))
    if last < first:
        raise ValueError(f"no months between {start} and {end}")
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def _month_number(month: str) -> int:
    parsed = date.fromisoformat(f"{month}-01")
    return parsed.year * 12 + parsed.month - 1


def write_months(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Write a table with one folder per ``month``; hot months are split over tasks.

    Rows that lie together by month already, in ``month_parts`` parts, are ``dealt``: they are written where they are.
    """
    # A task sorts its rows by month anyway; by opening beside it, like rows lie together and take less room.
    order = [c for c in ("month", "matched_id") if c in df.columns]
    together = df.sortWithinPartitions(*order) if dealt else df.hint("rebalance", "month")
    together.write.mode("overwrite").partitionBy("month").parquet(path)


def month_parts(spark: SparkSession, months: int) -> int:
    """Parts to deal each month to, so that every task of a shuffle has some: eight on average, and eight tasks a month at least."""
    return max(8, -(-8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // months))


def read_months(spark: SparkSession, path: str, start: str, end: str | None = None) -> DataFrame:
    """Rows of the months in range; other months' folders are not read."""
    month = F.col("month").cast("string")
    return spark.read.option("basePath", path).schema(_with_month(spark, path)).parquet(path).where(
        month.isin(month_range(start, end))
    )


def _with_month(spark: SparkSession, path: str) -> StructType:
    schema = spark.read.parquet(path).drop("month").schema
    return schema.add("month", "string")


def read_month_stages(spark: SparkSession, root: str, stage: str, start: str, end: str | None = None) -> DataFrame:
    """The monthly tables in range, as one scan over their files."""
    return spark.read.parquet(*[stage_path(root, stage, m) for m in month_range(start, end)])


def read_known(spark: SparkSession, path: str, key: str, schema: str, order: str | None = None) -> DataFrame:
    """A table of known entities, one row per key; empty if nothing was saved yet.

    Of several rows with one key the first by ``order`` counts, without an order the one whose other columns are least.
    """
    recover(spark, path)
    try:
        known = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return dedupe_known(known, key, order)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; sorted frames keep their order over the part files."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def checkpointed(df: DataFrame, path: str, batch: int) -> None:
    """Save one batch beside the final table; repeating a batch replaces it."""
    recover(df.sparkSession, path)
    df.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}_temp/batch={batch}")


def promote(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Replace the final table by ``known`` plus all saved batches, then drop the batches.

    ``known`` may be read from ``path`` itself: the new table is written beside it and takes its place when it is whole.
    The commit point is one rename: once the new table is whole, the batches' folder is renamed to ``_merged``. A run that
    stops before it is repeated with the same batches, one that stops after it is finished by ``recover`` and adds nothing
    twice. Without new batches the table stays as it is.
    """
    recover(spark, path)
    if path_exists(spark, f"{path}_temp"):
        commit_batches(spark, path, known)
        recover(spark, path)
    return spark.read.parquet(path)


def commit_batches(spark: SparkSession, path: str, known: DataFrame | None = None) -> None:
    """The first half of ``promote``: the new table beside the old one, then the commit point."""
    batches = spark.read.option("mergeSchema", True).parquet(f"{path}_temp").drop("batch")
    merged = batches if known is None else known.unionByName(batches, allowMissingColumns=True)
    merged.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}_next")
    rename_path(spark, f"{path}_temp", f"{path}_merged")


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a promotion that stopped after its commit point; whether there was one.

    ``read_known`` does this before it reads, so that a table planned on the state before never meets the batches again.
    """
    if not path_exists(spark, f"{path}_merged"):
        return False
    if path_exists(spark, f"{path}_next"):
        move_path(spark, f"{path}_next", path)
    delete_path(spark, f"{path}_old")
    delete_path(spark, f"{path}_merged")
    return True


def replace_table(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a frame, which may be read from ``path``, beside it and then let it take that place."""
    staged = f"{path}_next"
    df.write.mode("overwrite").option("compression", compression).parquet(staged)
    move_path(df.sparkSession, staged, path)
