"""Game records: text files in, one row of columns per game out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstats.functions.moves import PLAIN_TAGS, ROSTER_TAGS, move_tokens, opening_name, sequence_key, tag

MARKER = "[Event "


def read_game_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (``record``) per game.

    A record starts at a line beginning with the marker and runs to the next one, so the
    marker itself is the record separator and files stay splittable. Text before a
    file's first marker is no record and is left out.
    """
    chunks = spark.read.option("lineSep", "\n" + MARKER).text(path)
    whole, cut = F.startswith("value", F.lit(MARKER)), F.startswith("value", F.lit('"'))
    restored = F.when(whole, F.col("value")).otherwise(F.concat(F.lit(MARKER), "value"))
    unified = F.when(F.contains("value", F.lit("\r")), F.regexp_replace(restored, r"\r\n?", "\n")).otherwise(restored)
    return chunks.where(whole | cut).select(unified.alias("record"))


def header_columns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add players, result, ratings, event and opening name as strings.

    Missing roster tags get the standard's placeholder, other missing tags are NULL.
    """
    named = {
        "White": "white", "Black": "black", "Result": "result", "Event": "event",
        "WhiteElo": "w_elo", "BlackElo": "b_elo", "Opening": "original_name",
    }
    text = F.col(record)
    columns = {named[t]: F.coalesce(tag(text, t), F.lit(absent)) for t, absent in ROSTER_TAGS.items()}
    columns |= {named[t]: tag(text, t) for t in PLAIN_TAGS}
    return records.withColumns(columns)


def parse_games(records: DataFrame, n: int = 10, record: str = "record") -> DataFrame:
    """Game rows: headers, opening name and the first ``n`` half-moves as one key."""
    return header_columns(records, record).select(
        "white",
        "black",
        opening_name(F.col("original_name")).alias("original_name"),
        sequence_key(move_tokens(F.col(record), n)).alias("original_moves"),
        "result",
        "w_elo",
        "b_elo",
        "event",
    )


def ordered_sequence(events: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """First ``n`` values per key, in order, joined to one sequence key.

    The rank filter is applied within each input partition before the shuffle, so a hot
    key sends at most ``n`` rows per partition.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = events.select(*keys, *order, value, rank.alias("_rank")).where(F.col("_rank") <= n)
    steps = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(sequence_key(F.transform(steps, lambda s: s["v"])).alias("moves"))
