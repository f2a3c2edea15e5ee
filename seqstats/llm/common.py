"""What the operators of this folder share: table reading, UTF-8 columns, words, bounded samples of labels."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of rows that go to Python together. Spark's default of 64 MB is held several times over by an executor's tasks.
BATCH_BYTES = 8 * 1024 * 1024
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``BATCH_BYTES`` at most, or of a longer row alone.

    The session's setting is lowered to that if it is higher.
    """
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_SETTING)) or 0) > BATCH_BYTES:
        conf.set(_SETTING, f"{BATCH_BYTES}b")

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back, so that a worker that waits or goes on to another step holds only what it needs."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The rows of a text column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches_of(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``size`` bytes; a longer row is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start = i
            total = 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, column: str, rows: int, parts: int = 1, left_out: int = -1, value: int | None = None
):
    """Texts and labels of at most ``rows`` labelled documents, the first in the order of a hash of the id.

    ``rows`` is the bound that makes the sample fit a broadcast and the driver; it does not depend on the input's size.
    Documents whose crc32(id as text) mod ``parts`` equals ``left_out`` are never taken, neither are null ids, null labels or
    ids with contradicting labels. Of several documents with one id, all count. ``value``: only documents of this label.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold != left_out))
        .groupBy("doc_id")
        .agg(F.min(column).alias("_label"), F.max(column).alias("_most"))
        .where("_label = _most" if value is None else f"_label = _most and _label = {value}")
        .select("doc_id", F.col("_label").cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return documents.join(F.broadcast(known), "doc_id")
