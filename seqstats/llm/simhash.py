"""SimHash near-duplicates by an inverted index over positional bytes with count filtering.

A fingerprint has a bit where over half of the hashes of a text's word shingles have it. Two fingerprints of 64 bits that
differ in at most four bits agree in at least four of their eight bytes, by place. The index is keyed by three places and
their bytes; the triples are chosen so that any four places hold one of them, hence no pair with four shared bytes is
missed. Inside a posting list the shared bytes of a pair are tallied, pairs below four are dropped and the rest verified by
their bits. A posting list yields at most one link per member (a spanning forest), never all pairs.

Equal fingerprints are one entry of the index, so copies cost nothing; a list longer than ``LONG_LIST`` is split by a fourth
shared byte. Links become components by spreading the least label along them, tables in the shared folder between rounds.

Null and empty texts have the fingerprint 0 and are linked like any other. Null ids take part, but name no component unless
it has no other id. Repeated rows are one node. Very long texts are hashed whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, utf8
from seqstats.session import written

SHINGLE, DISTANCE, SEED = 4, 4, 42
LEAST_SHARED = 8 - DISTANCE
#: Posting lists longer than this are split by a fourth byte.
LONG_LIST = 4_096
#: Lists up to this length are compared all at once with the others of a batch.
SHORT_LIST = 48
HASHED_AT_ONCE = 100_000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the places 0 to 7 such that every four places hold one (three groups of places in a ring)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    chosen = [g for g in groups if len(g) == 3]
    for here, there in zip(groups, groups[1:] + groups[:1]):
        chosen += [(*pair, place) for pair in itertools.combinations(here, 2) for place in there]
    return chosen


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    words = _WORDS.findall(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    first, last = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    counts, total = np.zeros(64, np.int64), len(first)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, total, HASHED_AT_ONCE):
        places = zip(first[at : at + HASHED_AT_ONCE].tolist(), last[at : at + HASHED_AT_ONCE].tolist())
        values = np.array([hashed(joined[a:b], seed) for a, b in places], ">u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed number) and ``text_hash`` of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return map_batches(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, fp bigint, text_hash bigint")


def byte_at(column: str, place: int):
    return F.shiftrightunsigned(F.col(column), 8 * (7 - place)).bitwiseAND(F.lit(255))


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs share enough bytes and differ in at most ``distance`` bits."""
    differing = a ^ b
    good = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED
    good[good] = np.bitwise_count(differing[good]) <= distance
    return good


def forest(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within whole posting lists (equal ``keys`` side by side), one per member at most."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    label = np.arange(n)
    short = np.repeat(sizes <= SHORT_LIST, sizes)
    left, right = [], []
    for step in range(1, int(min(SHORT_LIST, sizes.max(initial=1)))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        if not len(at):
            break
        at = at[near(prints[at], prints[at + step], distance)]
        left.append(at)
        right.append(at + step)
    a, b = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    for start, size in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST]):
        label[start : start + size] = start + spread(prints[start : start + size], distance)
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


def spread(prints: np.ndarray, distance: int) -> np.ndarray:
    """For each member of a long list the first of its component: members once reached are compared with the rest only."""
    label = np.arange(len(prints))
    rest = np.arange(len(prints))
    while len(rest):
        first, rest = rest[0], rest[1:]
        waiting = [first]
        while waiting and len(rest):
            here = waiting.pop()
            good = near(np.broadcast_to(prints[here], len(rest)).copy(), prints[rest], distance)
            reached, rest = rest[good], rest[~good]
            label[reached] = first
            waiting.extend(reached.tolist())
    return label


def listed(postings: DataFrame, distance: int) -> DataFrame:
    """Links from posting lists (``key``, ``fp``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for frame in itertools.chain(batches, [None]):
            if frame is not None:
                if not len(frame):
                    continue
                keys = np.concatenate([keys, frame["key"].to_numpy()])
                prints = np.concatenate([prints, frame["fp"].to_numpy().view(np.uint64)])
            # the last list may go on in the next batch
            whole = len(keys) if frame is None else int(np.searchsorted(keys, keys[-1]))
            if whole and (frame is None or whole >= 5_000):
                a, b = forest(keys[:whole], prints[:whole], distance)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
                keys, prints = keys[whole:], prints[whole:]

    lists = postings.repartition("key").sortWithinPartitions("key", "fp")
    return lists.mapInPandas(run, "a bigint, b bigint")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints (``fp``) that join all that are near, directly or in steps."""
    if distance > DISTANCE:
        raise ValueError("the triples guarantee a hit for a distance of four bits at most")

    def key(places: tuple[int, ...], number: int):
        packed = F.lit(number).cast("bigint")
        for place in places:
            packed = F.shiftleft(packed, 8).bitwiseOR(byte_at("fp", place))
        return packed

    postings = prints.select("fp", F.posexplode(F.array(*[key(t, i) for i, t in enumerate(triples())])).alias("triple", "key"))
    sized = postings.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")
    few = sized.where(F.col("n") <= LONG_LIST).select("key", "fp")
    fourth = F.explode(
        F.array(*[F.shiftleft(F.shiftleft(F.col("key"), 3).bitwiseOR(F.lit(p)), 8).bitwiseOR(byte_at("fp", p)) for p in range(8)])
    )
    # a place of the triple itself would give the same list again
    outside = [F.array_contains(F.array(*[F.lit(i) for i, t in enumerate(triples()) if p in t]), F.col("triple")) for p in range(8)]
    place = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(7))
    inside = F.lit(False)
    for p in range(8):
        inside = inside | ((place == p) & outside[p])
    many = sized.where(F.col("n") > LONG_LIST).select("triple", fourth.alias("key"), "fp").where(~inside).select("key", "fp")
    return listed(few, distance).unionByName(listed(many, distance)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp`` and ``root`` (the least fingerprint of its component) of every end of an edge.

    Each round takes the least label among the neighbours and then that label's own label, so long chains shrink fast.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        around = both.join(labels.withColumnsRenamed({"a": "b", "root": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        stepped = labels.join(around, "a").select("a", "root", F.least("root", "other").alias("low"))
        jumps = labels.withColumnsRenamed({"a": "low", "root": "lower"})
        following = written(
            stepped.join(jumps, "low").select("a", F.col("lower").alias("root"), (F.col("lower") != F.col("root")).alias("moved")), "labels"
        )
        moved = following.where("moved").limit(1).count()
        labels = following.select("a", "root")
        if not moved:
            return labels.withColumnRenamed("a", "fp")


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Every row's ``doc_id``, ``fp``, ``text_hash`` and ``root`` (a number that names its component)."""
    rows = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    found = components(links(rows.select("fp").distinct(), distance))
    return rows.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def report(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Every document's fingerprint and the smallest id reachable by links."""
    rows = grouped(documents, shingle=shingle, distance=distance).select("doc_id", "fp", "root")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, unchanged: that of the smallest id, of several texts with it the one of the least hash."""
    chosen = (
        grouped(docs, shingle=shingle, distance=distance)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))).alias("_row"))
        .select("_row._id", "_row._hash")
    )
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    hashed = plain.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    match = hashed[at].eqNullSafe(chosen["_id"]) & (hashed["_hash"] == chosen["_hash"])
    kept = hashed.join(chosen, match, "left_semi").dropDuplicates([at, "_hash"])
    return kept.select(*names).toDF(*docs.columns)
