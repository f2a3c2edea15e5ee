"""LM scoring with an n-gram trie in Elias-Fano coded, memory-mapped levels.

Training counts all words and all pairs of neighbouring words of the documents that are not held out. The trie has a level of
words (64-bit hashes, coded as a monotone sequence; a word's id is its place) and a level of successors: monotone pointers
give each word's range of successors, whose ids are coded relative to the range. A pair is looked up by a successor search
inside its context's range. Probabilities are smoothed by absolute discounting, interpolated with the add-0.1 probability of
the word alone, and quantised to 16 bits.

Both levels are cut into shards by ranges of word hashes. A shard is built by one task from counts that were already added
up per block, and written to the shared folder; scoring tasks map the shards and touch only what their documents need, so
neither the driver nor a worker ever holds the trie. The number of shards follows the size of the texts. A shard of successors
whose words have more than ``SLICE_TOKENS`` tokens (one very frequent word is enough) is cut into slices by ranges of the
successor: each is built by a task of its own, after the slices' numbers of successors per context were added up. So a slice has
its share of a frequent word's successors, and of a frequent successor one pair for each word of the shard. Tasks find the files
through a directory file, so nothing that grows with the corpus travels with the code.

A text's tokens are its words, A-Z lower-cased, and one end; the end is never a context. Null and empty texts have only the
end. Repeated rows count and are scored each for itself. Documents with a null id are not held out. Without training text
every token has the same probability of an unseen word. Very long texts are read block by block.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import WORD, map_batches, utf8
from seqstats.llm.elias_fano import EliasFano
from seqstats.session import delete_path, fresh_dir, written

PARTS, LEFT_OUT = 10, 0
ADDED, DISCOUNT = 0.1, 0.75
#: Log probabilities from this to 0 are dealt into 65,536 steps.
LOWEST = -16.0
END = b"\n"
#: Bytes of text whose words and pairs make one shard, and tokens that are counted or scored together.
SHARD_BYTES = 24_000_000
BLOCK_TOKENS = 500_000
#: Tokens of a shard's words for which its successors get one slice more.
SLICE_TOKENS = 8_000_000
#: Distinct counts a task gathers before it hands them on.
GATHERED = 6_000_000

U = np.uint64


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of whole texts, or of pieces of long ones, in blocks: distinct hashes (sorted), each token's place among them,
    the row of each token, and whether the token follows another one of its text inside the block.

    A long text's pieces overlap by one token, whose row is -1: it is a context only.
    """
    waiting: list[bytes] = []
    rows: list[int] = []
    sizes: list[int] = []
    held = 0
    for row, text in enumerate(texts):
        words = (m.group() for m in WORD.finditer(text.lower())) if len(text) > 8 * BLOCK_TOKENS else iter(WORD.findall(text.lower()))
        words = itertools.chain(words, [END])
        last = None
        while piece := list(itertools.islice(words, BLOCK_TOKENS)):
            if last is not None:
                waiting.append(last)
                rows.append(-1)
                sizes.append(1)
                piece_starts = False
            else:
                piece_starts = True
            waiting += piece
            rows.append(row)
            sizes.append(len(piece) if piece_starts else -len(piece))
            held += len(piece)
            last = piece[-1]
            if held >= BLOCK_TOKENS:
                yield block_of(waiting, rows, sizes)
                waiting, rows, sizes, held = [], [], [], 0
    if waiting:
        yield block_of(waiting, rows, sizes)


def block_of(tokens: list[bytes], rows: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(np.array(tokens, dtype=object))
    hashes, back = np.unique(np.array([hash_of(w) for w in distinct], U), return_inverse=True)
    lengths = np.abs(np.array(sizes))
    follows = np.ones(len(tokens), bool)
    starts = np.cumsum(lengths) - lengths
    follows[starts[np.array(sizes) > 0]] = False
    follows[starts[np.array(rows) < 0]] = False
    return hashes, back[codes], np.repeat(np.array(rows), lengths), follows


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


# --- shards as files -----------------------------------------------------------------------


def save(folder: str, label: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays one after the other in a file of the shared folder, after a line that tells their places."""
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = (at, array.dtype.str, len(array))
        at += (array.nbytes + 7) // 8 * 8
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(head)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes())
            out.write(b"\0" * (-array.nbytes % 8))
    return path


@functools.lru_cache(maxsize=4096)
def load(path: str) -> dict[str, np.ndarray]:
    """``read`` for the files of the trie, which are read often."""
    return read(path)


def read(path: str) -> dict[str, np.ndarray]:
    """A saved file's arrays, memory-mapped: in place if every executor mounts the folder, else from a copy without a name."""
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        data = np.memmap(inner, np.uint8, "r")
    else:
        with system.open_input_stream(inner) as source, tempfile.TemporaryFile() as copy:
            shutil.copyfileobj(source, copy, 1 << 20)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
    head = data[: int(np.argmax(data[:65_536] == 10)) + 1].tobytes()
    start = len(head)
    return {
        name: data[start + at : start + at + size * np.dtype(kind).itemsize].view(kind)
        for name, (at, kind, size) in json.loads(head).items()
    }


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def sequence(prefix: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{prefix}{i}": a for i, a in enumerate(EliasFano.of(values).arrays())}


def mapped(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano.from_arrays(*(arrays[f"{prefix}{i}"] for i in range(4)))


# --- the trie ------------------------------------------------------------------------------


@dataclass
class Trie:
    """Numbers of shards, tokens and distinct words, and the file that tells where the shards are."""

    shards: int
    tokens: int
    distinct: int
    directory: str

    def part(self, name: str) -> np.ndarray:
        return load(self.directory)[name]

    def file(self, name: str, number: int) -> dict[str, np.ndarray]:
        return load(self.part(name)[number].decode())

    @property
    def first(self) -> np.ndarray:
        """The id of each shard's first word, and the number of words."""
        return self.part("first")

    @property
    def slices(self) -> np.ndarray:
        """The number of each shard's first slice, and the number of slices."""
        return self.part("slices")

    def slice_of(self, shards: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The slices that hold a word's successions to contexts of the shards."""
        start = self.slices[shards]
        cut = (self.slices[shards + 1] - start).astype(U)
        return start + (words.astype(U) * cut // U(max(1, self.distinct))).astype(np.int64)

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return shard_of(hashes, self.shards)

    def unseen(self) -> float:
        return ADDED / (self.tokens + ADDED * (self.distinct + 1))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unseen) and counts of words given by sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(self.shard_of(hashes), np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            arrays = self.file("words", shard)
            here = slice(bounds[shard], bounds[shard + 1])
            place, found = mapped(arrays, "hash").find(hashes[here] - U(floor_of(shard, self.shards)))
            place = place[found]
            ids[here][found] = self.first[shard] + place
            counts[here][found] = arrays["count"][place]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by sorted id."""
        out = np.zeros(len(ids), np.int64)
        bounds = np.searchsorted(ids, self.first)
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            here = slice(bounds[shard], bounds[shard + 1])
            out[here] = self.file("words", shard)["count"][ids[here] - self.first[shard]]
        return out

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities of words without a context."""
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))

    def after(self, contexts: np.ndarray, words: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Log probabilities of words after known contexts, in the order of the contexts' ids."""
        out = np.zeros(len(words))
        bounds = np.searchsorted(contexts, self.first)
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            here = slice(bounds[shard], bounds[shard + 1])
            context, word = contexts[here] - self.first[shard], words[here]
            value = from_steps(self.file("backs", shard)["back"][context]) + alone[here]
            known = np.flatnonzero(word >= 0)
            numbers = self.slice_of(np.full(len(known), shard), word[known])
            for number in np.unique(numbers).tolist():
                at = known[numbers == number]
                arrays = self.file("pairs", number)
                starts, successors = mapped(arrays, "start"), mapped(arrays, "next")
                # the range of the context's successors, and the search inside it by id relative to the range
                distinct, back = np.unique(context[at], return_inverse=True)
                start, end = starts[distinct].astype(np.int64)[back], starts[distinct + 1].astype(np.int64)[back]
                place, found = successors.find(context[at].astype(U) * U(self.distinct) + word[at].astype(U))
                found &= (place >= start) & (place < end)
                value[at[found]] = from_steps(arrays["probability"][place[found]])
            out[here] = value
        return out


def floor_of(shard: int, shards: int) -> int:
    return -(-(shard << 64) // shards)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    floors = np.array([floor_of(s, shards) for s in range(shards)], U)
    return np.searchsorted(floors, hashes, side="right") - 1


def to_steps(log: np.ndarray) -> np.ndarray:
    return np.round(np.clip(log / LOWEST, 0, 1) * 65_535).astype(np.uint16)


def from_steps(steps: np.ndarray) -> np.ndarray:
    return steps.astype(float) * (LOWEST / 65_535)


def handed_on(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pd.DataFrame:
    """One row per shard: its keys (8 bytes each) and counts (4 bytes each)."""
    bounds = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    parts = list(itertools.pairwise(bounds.tolist()))
    return pd.DataFrame(
        {
            "shard": np.array([shards[a] for a, _ in parts], np.int32),
            "keys": [deltas(keys[a:b]) for a, b in parts],
            "counts": [counts[a:b].astype("<u4").tobytes() for a, b in parts],
        }
    )


def deltas(keys: np.ndarray) -> bytes:
    """Increasing keys as differences, byte planes apart, so that the shuffle's compression finds the zeros."""
    steps = np.diff(keys, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def undone(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


HANDED = "shard int, keys binary, counts binary"


def word_counts(texts: DataFrame, shards: int) -> DataFrame:
    """Counts of the words of ``text``, added up per task, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush():
            key, count = summed(keys, counts)
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_pandas(handed_on(key, count, shard_of(key, shards)), schema=HANDED_ARROW, preserve_index=False)

        for batch in batches:
            for hashes, places, rows, _ in blocks(utf8(batch.column(0))):
                keys.append(hashes)
                counts.append(np.bincount(places[rows >= 0], minlength=len(hashes)))
                held += len(hashes)
                if held > GATHERED:
                    key, count = summed(keys, counts)
                    keys[:], counts[:], held = [key], [count], len(key)
                    if held > GATHERED // 2:
                        yield flush()
                        held = 0
        yield flush()

    return map_batches(texts, run, HANDED)


HANDED_ARROW = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def pair_counts(texts: DataFrame, trie: Trie) -> DataFrame:
    """Counts of pairs of neighbouring words, added up per task, by slice; keys are relative to the first word's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        size = U(trie.distinct)

        def flush():
            key, count = summed(keys, counts)
            keys.clear()
            counts.clear()
            shard = np.searchsorted(trie.first, (key // size).astype(np.int64), side="right") - 1
            relative = key - trie.first[shard].astype(U) * size
            number = trie.slice_of(shard, relative % size)
            order = np.argsort(number, kind="stable")
            handed = handed_on(relative[order], count[order], number[order])
            return pa.RecordBatch.from_pandas(handed, schema=HANDED_ARROW, preserve_index=False)

        for batch in batches:
            for hashes, places, _, follows in blocks(utf8(batch.column(0))):
                ids = trie.lookup(hashes)[0].astype(U)[places]
                second = np.flatnonzero(follows)
                key, count = np.unique(ids[second - 1] * size + ids[second], return_counts=True)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held > GATHERED:
                    key, count = summed(keys, counts)
                    keys[:], counts[:], held = [key], [count], len(key)
                    if held > GATHERED // 2:
                        yield flush()
                        held = 0
        yield flush()

    return map_batches(texts, run, HANDED)


def built_words(counted: DataFrame, folder: str, shards: int) -> DataFrame:
    """A file of words per shard."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        key, count = summed([undone(x) for x in frame["keys"]], [np.frombuffer(x, "<u4") for x in frame["counts"]])
        path = save(folder, f"words-{shard}", sequence("hash", key - U(floor_of(shard, shards))) | {"count": count.astype("<u8")})
        return pd.DataFrame({"shard": [shard], "path": [path], "words": [len(key)], "tokens": [int(count.sum())]})

    return counted.groupBy("shard").applyInPandas(build, "shard int, path string, words bigint, tokens bigint")


def saved_pairs(trie: Trie, folder: str, number: int, key: np.ndarray, count: np.ndarray, kinds: np.ndarray, total: np.ndarray) -> str:
    """The file of a slice: pointers, successors and their probabilities. ``kinds``, ``total``: of all slices of the shard."""
    context, word = (key // U(trie.distinct)).astype(np.int64), (key % U(trie.distinct)).astype(np.int64)
    own = np.bincount(context, minlength=len(kinds))
    spare = DISCOUNT * kinds / np.maximum(total, 1)
    distinct, back = np.unique(word, return_inverse=True)
    alone = 10 ** trie.alone(trie.counts_of(distinct))[back]
    probability = (count - DISCOUNT) / total[context] + spare[context] * alone
    arrays = sequence("start", np.concatenate([[0], np.cumsum(own)])) | sequence("next", key)
    return save(folder, f"pairs-{number}", arrays | {"probability": to_steps(np.log10(probability))})


def saved_back(folder: str, shard: int, kinds: np.ndarray, total: np.ndarray) -> str:
    """The file of a shard's shares left to words alone; 1 for a word that nothing follows."""
    spare = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return save(folder, f"back-{shard}", {"back": to_steps(np.log10(spare))})


def built_pairs(counted: DataFrame, folder: str, trie: Trie) -> DataFrame:
    """A file of successors per slice (``shard`` of ``counted``). A shard of one slice is done with it, and has ``back``;
    other slices are added up and put aside with their numbers of successors and of successions per context."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["shard"].iloc[0])
        shard = int(np.searchsorted(trie.slices, number, side="right")) - 1
        key, count = summed([undone(x) for x in frame["keys"]], [np.frombuffer(x, "<u4") for x in frame["counts"]])
        contexts = int(trie.first[shard + 1] - trie.first[shard])
        context = (key // U(trie.distinct)).astype(np.int64)
        kinds, total = np.bincount(context, minlength=contexts), np.bincount(context, count, minlength=contexts).astype(np.int64)
        if trie.slices[shard + 1] - trie.slices[shard] == 1:
            path, back = saved_pairs(trie, folder, number, key, count, kinds, total), saved_back(folder, shard, kinds, total)
        else:
            path, back = save(f"{folder}/aside", f"pairs-{number}", {"key": key, "count": count, "kinds": kinds, "total": total}), None
        return pd.DataFrame({"shard": [shard], "number": [number], "path": [path], "back": [back]})

    return counted.groupBy("shard").applyInPandas(build, "shard int, number int, path string, back string")


def added_up(aside: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Per shard of several slices: a file of the numbers per context over all slices, and its ``back``."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        shard, sums = int(frame["shard"].iloc[0]), {}
        for path in frame["path"]:
            part = read(path)
            sums = {name: sums.get(name, 0) + part[name] for name in ("kinds", "total")}
        back = saved_back(folder, shard, **sums)
        return pd.DataFrame({"shard": [shard], "sums": [save(f"{folder}/aside", f"sums-{shard}", sums)], "back": [back]})

    return aside.repartition(tasks, "shard").groupBy("shard").applyInPandas(add, "shard int, sums string, back string")


def finished_slices(aside: DataFrame, sums: DataFrame, folder: str, trie: Trie, tasks: int) -> DataFrame:
    """The files of the slices that were put aside."""

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, path, added in zip(frame["number"], frame["path"], frame["sums"]):
                part, whole = read(path), read(added)
                done = saved_pairs(trie, folder, number, part["key"], part["count"], whole["kinds"], whole["total"])
                yield pd.DataFrame({"number": [number], "path": [done]})

    joined = aside.select("shard", "number", "path").join(sums.select("shard", "sums"), "shard")
    return joined.repartition(tasks, "number").mapInPandas(finish, "number int, path string")


def train(documents: DataFrame, text_col: str = "text") -> Trie:
    """The trie of all rows of ``documents``. The driver learns one file name per shard and slice."""
    spark = documents.sparkSession
    shared = fresh_dir(spark, "trie")
    folder = uri(shared)
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = 1 + int(size) // SHARD_BYTES
    found = {r.shard: r for r in written(built_words(word_counts(texts, shards), folder, shards), "word-shards").collect()}
    empty = save(folder, "words-none", sequence("hash", np.zeros(0, U)) | {"count": np.zeros(0, "<u8")})
    words = [found[s].path if s in found else empty for s in range(shards)]
    first = np.concatenate([[0], np.cumsum([found[s].words if s in found else 0 for s in range(shards)])]).astype(np.int64)
    if (distinct := int(first[-1])) >= 1 << 32:
        raise OverflowError(f"{distinct} distinct words: a pair's key has room for 2^32")
    cuts = [1 + (found[s].tokens if s in found else 0) // SLICE_TOKENS for s in range(shards)]
    places = {"words": np.array(words, "S"), "first": first, "slices": np.concatenate([[0], np.cumsum(cuts)]).astype(np.int64)}
    tokens = sum(r.tokens for r in found.values())
    trie = Trie(shards, tokens, distinct, save(folder, "directory", places))
    built = written(built_pairs(pair_counts(texts, trie), folder, trie), "pair-shards")
    aside = built.where("back IS NULL")
    rows = built.collect()
    pairs = {r.number: r.path for r in rows if r.back}
    backs = {r.shard: r.back for r in rows if r.back}
    if tasks := sum(r.back is None for r in rows):
        sums = written(added_up(aside, folder, tasks), "pair-sums")
        backs |= {r.shard: r.back for r in sums.collect()}
        pairs |= {r.number: r.path for r in written(finished_slices(aside, sums, folder, trie, tasks), "pair-slices").collect()}
        delete_path(spark, f"{shared}/aside")
    for s in range(shards):
        nothing = np.zeros(first[s + 1] - first[s], np.int64)
        if s not in backs:
            backs[s] = saved_back(folder, s, nothing, nothing)
        if missing := [k for k in range(places["slices"][s], places["slices"][s + 1]) if k not in pairs]:
            path = saved_pairs(trie, folder, missing[0], np.zeros(0, U), np.zeros(0, np.int64), nothing, nothing)
            pairs |= dict.fromkeys(missing, path)
    places |= {name: np.array([found[k] for k in range(len(found))], "S") for name, found in (("pairs", pairs), ("backs", backs))}
    return Trie(shards, tokens, distinct, save(folder, "directory", places))


def scored(documents: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row."""
    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens bigint, n_known bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            totals = np.zeros((4, len(texts)))
            for hashes, places, rows, follows in blocks(texts):
                ids, counts = trie.lookup(hashes)
                alone = trie.alone(counts)
                base = alone[places]
                score = base.copy()
                second = np.flatnonzero(follows)
                second = second[ids[places[second - 1]] >= 0]
                pair, back = np.unique(places[second - 1].astype(np.int64) * len(hashes) + places[second], return_inverse=True)
                context, word = pair // max(1, len(hashes)), pair % max(1, len(hashes))
                # ids rise with the hashes, so the distinct pairs come in the order of their contexts' ids
                score[second] = trie.after(ids[context], ids[word], alone[word])[back]
                own = rows >= 0
                for total, value in zip(totals, (None, counts[places][own] > 0, base[own], score[own])):
                    total += np.bincount(rows[own], value, len(texts))
            new = [batch.column(0), *(pa.array(t.astype(np.int64)) for t in totals[:2]), *(pa.array(t) for t in totals[2:])]
            yield pa.RecordBatch.from_arrays(new, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return map_batches(source, run, schema)


def report(documents: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS
    held = F.coalesce(fold == LEFT_OUT, F.lit(False))
    trie = train(documents.where(~held))
    return scored(documents, trie).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
