"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves the pre-tokens that are whole vocabulary entries, all distinct
pre-tokens of a block at once. The rest are merged by a heap of neighbouring pairs over a linked list of bytes.

Null texts count as empty and have no ids. Repeated rows are encoded each for itself. Very long texts are split into
pre-tokens block by block, so only their ids are held whole. Columns besides id and text are neither read nor returned.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, ragged

#: Pre-tokens looked up together, and characters from which a text is split block by block.
BLOCK_TOKENS = 200_000
LONG_TEXT = 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: a key's slot is its position in ``keys``' order of slots.

    Buckets are placed largest first, each by the first displacement that sends its keys to free slots; a bucket of one key
    takes the next free slot, stored as a negative displacement. Foreign keys are told apart by comparing the stored key.
    """

    def __init__(self, keys: list[bytes]):
        self.size, self.buckets = len(keys), max(1, len(keys) // 4)
        self.longest = max(map(len, keys), default=0)
        for self.base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F):
            h = self.hashes(keys)
            if len(np.unique(h)) == len(keys):
                break
        else:
            raise ValueError("vocabulary keys are not distinct")
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_of = np.full(max(1, self.size), -1, np.int64)
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        bucket = (h % np.uint64(self.buckets))[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        members = np.split(order, starts[1:]) if len(order) else []
        free = np.ones(self.size, bool)
        single = []
        for group in sorted(members, key=len, reverse=True):
            b = int(h[group[0]] % np.uint64(self.buckets))
            if len(group) == 1:
                single.append((b, group[0]))
                continue
            for first in itertools.count(1, 128):
                tries = np.arange(first, first + 128, dtype=np.uint64)
                slots = self.slots(h[group][None, :], tries[:, None])
                ordered = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (np.diff(ordered, axis=1) != 0).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    free[slots[k]] = False
                    self.key_of[slots[k]] = group
                    self.shift[b] = first + k
                    break
        for (b, key), slot in zip(single, np.flatnonzero(free)):
            self.shift[b], self.key_of[slot] = -slot - 1, key

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        """64-bit hashes of byte strings, all at once."""
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(max(1, int(lengths.max(initial=1))), self.base, np.uint64))
        ends = np.cumsum(lengths)
        place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[place])])
        return mixed(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))

    def slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the index of the only vocabulary key it can equal."""
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -shift - 1, self.slots(h, shift.clip(0).astype(np.uint64)))
        return self.key_of[slots]


def ranked_tokens(path: str) -> list[tuple[int, bytes]]:
    """Ranks and byte strings of a rank file, by rank."""
    with open(path, "rb") as file:
        return sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))


class TokenBytes:
    """The bytes of every id, all that decoding needs."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        lengths = np.zeros(max((rank for rank, _ in pairs), default=-1) + 1, np.int64)
        lengths[[rank for rank, _ in pairs]] = [len(token) for _, token in pairs]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(token for _, token in pairs), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


class Vocabulary:
    """Byte strings and their ranks, with the perfect hash over them."""

    def __init__(self, path: str, pattern: str):
        pairs = ranked_tokens(path)
        self.ids = np.array([rank for rank, _ in pairs], np.int64)
        self.tokens = [token for _, token in pairs]
        self.rank = {token: rank for rank, token in pairs}
        self.hash = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern)
        self.merged = functools.lru_cache(maxsize=1 << 17)(self.merge)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        n, get = len(word), self.rank.get
        pair = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair that starts at i, now
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:  # one of its sides has been merged away
                continue
            j = after[i]
            after[i] = k = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                if (r := get(word[i : after[k]], -1)) >= 0:
                    pair[i] = r
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                pair[h] = r = get(word[h:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + h)
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[word[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        keys = [w.encode() for w in distinct]
        found: list[tuple[int, ...] | None] = [None] * len(keys)
        short = [i for i, key in enumerate(keys) if len(key) <= self.hash.longest]
        for i, at in zip(short, self.hash.find([keys[i] for i in short]).tolist() if short else []):
            if self.tokens[at] == keys[i]:
                found[i] = (int(self.ids[at]),)
        # the cache keeps short words only, so that its size is bounded
        for i, key in enumerate(keys):
            if found[i] is None:
                found[i] = self.merged(key) if len(key) < 64 else self.merge(key)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        counts = lengths[codes]
        return flat[ragged(starts[codes], counts)], counts

    def encoded(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        waiting: list[tuple[int, list[str]]] = []
        done: list[list[bytes]] = [[] for _ in texts]

        def flush() -> None:
            ids, counts = self.encode(list(itertools.chain.from_iterable(w for _, w in waiting)))
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            for row, words in waiting:
                done[row].append(ids[ends[at] : ends[at + len(words)]].tobytes())
                at += len(words)
            waiting.clear()

        held = 0
        for row, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= LONG_TEXT:
                blocks = iter([self.pattern.findall(text)])
            else:
                matches = (m.group() for m in self.pattern.finditer(text))
                blocks = iter(lambda: list(itertools.islice(matches, BLOCK_TOKENS)), [])
            for words in blocks:
                waiting.append((row, words))
                held += len(words)
                if held >= BLOCK_TOKENS:
                    flush()
                    held = 0
        flush()
        return (b"".join(parts) for parts in done)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """A worker's vocabulary, read and hashed once."""
    return Vocabulary(path, pattern)


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(ranked_tokens(path))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    ``path`` is a rank file that every executor can open, ``pattern`` splits a text into pre-tokens.
    """
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = f"`{id_col}` {dict(source.dtypes)[id_col]}, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = list(known.encoded(part.column(1).to_pylist()))
                counts = [len(x) // 4 for x in ids]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids"])

    return map_batches(source, run, schema)


def decode(df: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded`` (binary), the bytes of their ``ids``; null ids have no bytes."""
    names = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", decoded binary"
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                decoded = pa.array([known.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*names, "decoded"])

    return map_batches(df, run, schema)


def encoded_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the bytes they decode to, for every document."""
    return decode(encode(df, path, pattern), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
