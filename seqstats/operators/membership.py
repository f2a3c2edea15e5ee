"""Membership filters: blocks of bits that say of a key "certainly not among these" or "perhaps".

A filter is a table of blocks of 256 bits; a key sets eight bits of one block, so a lookup is one join on the block's number.
Filters of the same number of blocks are united by OR. A filter has at most ``MOST_BLOCKS`` blocks and is broadcast; with more
keys than fit it only lets more rows through. Nothing rests on what it says of a key that it lets through: an exact anti join
decides there, so results do not depend on it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstats.session import path_exists, rename_path

BITS_PER_KEY = 16
BLOCK_BITS = 256
#: 40 bytes each: the bound of what is broadcast is 40 MB, room for 16 million keys at ``BITS_PER_KEY``.
MOST_BLOCKS = 1 << 20
WORDS = ["w0", "w1", "w2", "w3"]


def blocks_for(keys: int, most: int = MOST_BLOCKS) -> int:
    """Blocks for a number of keys: a power of two, so that tables of about one size have filters that can be united."""
    wanted = max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))
    return min(most, 1 << (wanted - 1).bit_length())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in the four words of its block, two in each, by six bits of a second hash per bit."""
    places = F.xxhash64(key, F.lit(1))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(places, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(8)
    ]
    return [bits[2 * i].bitwiseOR(bits[2 * i + 1]) for i in range(4)]


def key_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of all keys that are not null: one row per block that has a key."""
    masks = [m.alias(w) for w, m in zip(WORDS, _masks(F.col(key)))]
    return _united(keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), *masks))


def united_filters(filters: list[DataFrame]) -> DataFrame:
    """One filter of all keys of several ones with the same number of blocks."""
    every = filters[0]
    for other in filters[1:]:
        every = every.unionByName(other)
    return _united(every)


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def with_perhaps(df: DataFrame, key: Column, seen: DataFrame, blocks: int) -> DataFrame:
    """The rows with ``perhaps``: false where the key is certainly not among those of the filter ``seen``, or is null."""
    named = seen.select(F.col("block").alias("_block"), *[F.col(w).alias(f"_{w}") for w in WORDS])
    hit = F.lit(True)
    for word, mask in zip(WORDS, _masks(key)):
        hit = hit & (F.col(f"_{word}").bitwiseAND(mask) == mask)
    joined = df.join(F.broadcast(named), F.when(key.isNotNull(), _block(key, blocks)) == F.col("_block"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(hit, F.lit(False)).alias("perhaps"))


def anti_join(df: DataFrame, key: Column, known: DataFrame, known_key: str, seen: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key is not in ``known``; rows with a null key stay.

    What the filter ``seen`` of ``known`` rejects is not in it and is never shuffled; only the rest meets the known keys.
    """
    told = with_perhaps(df, key, seen, blocks)
    keys = known.select(F.col(known_key).alias("_known"))
    rest = told.where("perhaps").drop("perhaps").join(keys, key == F.col("_known"), "left_anti")
    return told.where("NOT perhaps").drop("perhaps").unionByName(rest)


def stored_filter(known: DataFrame, key: str, folder: str) -> tuple[DataFrame, int]:
    """The filter of a table that is read from files, and its number of blocks.

    It is built on first use and kept in ``folder`` under a digest of the table's file names, so a filter of another state
    of the table is never taken. It is written beside its place and appears by one rename.
    """
    spark = known.sparkSession
    names = sorted(x.rsplit("/", 1)[-1] for x in known.inputFiles())
    path = f"{folder}/{hashlib.sha256(' '.join([key, *names]).encode()).hexdigest()}"
    if not path_exists(spark, path):
        blocks = blocks_for(known.count())
        draft = f"{folder}/draft-{uuid.uuid4().hex}"
        key_filter(known, key, blocks).withColumn("blocks", F.lit(blocks)).write.parquet(draft)
        try:
            rename_path(spark, draft, path)
        except OSError:
            if not path_exists(spark, path):  # else another run has built the same one
                raise
    found = spark.read.parquet(path)
    size = found.select("blocks").first()
    return found.drop("blocks"), size["blocks"] if size else 1
