"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of letters and digits after lower-casing A-Z (every byte from 0x80 on is a letter). A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window as a whole. Document words
are streamed through the automaton, which keeps the longest match that ends at each word; where it reaches a window's
length, the window's words are hit. Only stretches whose neighbouring words are also neighbours in some item enter the
automaton, as no window occurs elsewhere.

Null texts have no words, null item ids are the item "null", items with one id are one item, repeated document rows are
judged each for itself, equal texts get equal marks, and empty tables give no rows or no hits. Very long documents are
streamed like any other. ``report`` reads id and text only; ``clean`` keeps further columns whatever they are called.

The items are dealt by hash to blocks of about ``BLOCK_BYTES`` of text, a table in the shared folder of which a task reads one
block by its number; no item passes through the driver, and an automaton's memory is bounded. With several blocks the
documents are numbered and written once; a block's pass hands on the numbers and marks of the rows that it hits, and the marks
of all blocks are united by number and joined to the texts at the end.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, utf8
from seqstats.session import fresh_dir, written

WINDOW = 10
#: Text of the items in one automaton: about 100 MB of a worker's memory.
BLOCK_BYTES = 2_000_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """All substrings of the items' word sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        sequences = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, seq in sequences:
            last = 0
            for word in seq:
                last = self.extend(last, word)
        # where windows end: by state, the items and the window's length
        self.ends: dict[int, dict[int, set[str]]] = {}
        for name, seq in sequences:
            size, state = min(window, len(seq)), 0
            for i, word in enumerate(seq):
                state = self.step[state][word]
                if i + 1 >= size:
                    while self.link[state] >= 0 and self.long[self.link[state]] >= size:
                        state = self.link[state]
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(name)
        self.shortest = min((n for sizes in self.ends.values() for n in sizes), default=0)
        # the next state up the links, itself included, at which a window ends
        self.above = [-1] * len(self.link)
        for state in np.argsort(self.long, kind="stable").tolist():
            up = self.link[state]
            self.above[state] = state if state in self.ends else (self.above[up] if up >= 0 else -1)
        pairs = {(a, b) for _, seq in sequences for a, b in zip(seq, seq[1:])}
        self.pairs = np.sort(np.array([a * (len(self.words) + 1) + b for a, b in pairs], np.int64))
        # a table of hashed pairs answers most questions without a search
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.hashed(self.pairs)] = True

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 12) & ((1 << 20) - 1)

    def extend(self, last: int, word: int) -> int:
        """Adds the word after state ``last``; returns the state of the longer sequence."""
        step, link, long = self.step, self.link, self.long
        if word in step[last]:
            old = step[last][word]
            return old if long[old] == long[last] + 1 else self.split(last, word, old)
        new = len(step)
        step.append({})
        long.append(long[last] + 1)
        link.append(0)
        while last >= 0 and word not in step[last]:
            step[last][word] = new
            last = link[last]
        if last >= 0:
            old = step[last][word]
            link[new] = old if long[old] == long[last] + 1 else self.split(last, word, old)
        return new

    def split(self, last: int, word: int, old: int) -> int:
        """A copy of state ``old`` for the sequences that end ``last`` and the word."""
        step, link, long = self.step, self.link, self.long
        copy = len(step)
        step.append(dict(step[old]))
        long.append(long[last] + 1)
        link.append(link[old])
        link[old] = copy
        while last >= 0 and step[last].get(word) == old:
            step[last][word] = copy
            last = link[last]
        return copy

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words outside which no window occurs."""
        if self.shortest == 0 or len(ids) < self.shortest:
            return
        known = ids >= 0
        if self.shortest == 1:
            near, least = known, 1
        else:
            keys = ids[:-1] * (len(self.words) + 1) + ids[1:]
            near = known[:-1] & known[1:] & self.mask[self.hashed(keys)]
            at = np.flatnonzero(near)
            found = np.searchsorted(self.pairs, keys[at])
            near[at] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == keys[at]
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        for i in np.flatnonzero(ends - starts >= least).tolist():
            yield int(starts[i]), int(ends[i]) + (self.shortest > 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal ranges of hit words, in order, and the items whose windows occur."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        step, link, long, above = self.step, self.link, self.long, self.above
        for start, end in self.stretches(ids):
            state = length = 0
            for i, word in enumerate(ids[start:end].tolist(), start):
                while word not in step[state] and state:
                    state = link[state]
                    length = long[state]
                if word not in step[state]:
                    continue
                state, length = step[state][word], length + 1
                at = above[state]
                while at > 0:
                    for size, names in self.ends[at].items():
                        if size <= length:
                            items |= names
                            first = i + 1 - size
                            while spans and spans[-1][1] >= first:
                                first = min(first, spans.pop()[0])
                            spans.append((first, i + 1))
                    at = above[link[at]] if link[at] >= 0 else -1
        return spans, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[str, int]:
    """The folder of the items' table, a folder for each block, and the number of blocks."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    ).distinct()
    count = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    folder = fresh_dir(benchmark.sparkSession, "items")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", count


def items_of(folder: str, block: int) -> list[tuple[str, list[bytes]]]:
    """A block's items and their words."""
    system, inner = pyarrow.fs.FileSystem.from_uri(folder)
    files = system.get_file_info(pyarrow.fs.FileSelector(f"{inner}/block={block}", allow_not_found=True))
    found = []
    for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
        with system.open_input_file(path) as source:
            rows = pyarrow.parquet.ParquetFile(source).read(["item", "text"])
        found += zip(rows.column("item").to_pylist(), map(normal_words, utf8(rows.column("text").combine_chunks())))
    return found


def normal_words(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


def mark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows with ``_n_words``, ``_hits`` (ranges of hit words) and ``_items`` (items whose windows occur, sorted)."""
    folder, blocks = item_blocks(benchmark, item_id, item_text)
    at = docs.columns.index(text_col)
    marks = ", ".join(f"{name} {kind}" for name, kind in MARKS.items())
    if blocks == 1:
        schema = docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in MARKS.items())).schema
        return map_batches(docs, marker(folder, 0, at, window, list(range(len(docs.columns)))), schema)
    numbered = written(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("_row", f"c{at}")
    passes = [map_batches(rows, marker(folder, b, 1, window, [0], only_hit=b > 0), f"_row bigint, {marks}") for b in range(blocks)]
    united = functools.reduce(DataFrame.unionAll, passes).groupBy("_row").agg(
        F.max("_n_words").alias("_n_words"),
        F.flatten(F.collect_list("_hits")).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
    )
    united = map_batches(united, merged, united.schema)
    return numbered.join(united, "_row").drop("_row").toDF(*docs.columns, *MARKS)


MARKS = {"_n_words": "bigint", "_hits": "array<array<int>>", "_items": "array<string>"}


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the ranges of all blocks as maximal ranges."""
    for batch in batches:
        hits = pa.array([joined([tuple(x) for x in h]) for h in batch.column(2).to_pylist()], batch.schema.types[2])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], hits, batch.column(3)], names=batch.schema.names)


def marker(
    folder: str, block: int, at: int, window: int, keep: list[int], only_hit: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns ``keep`` and the marks of one block for all rows, or for those that it hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(items_of(folder, block), window)
        for batch in batches:
            counts, hits, items = [], [], []
            for text in utf8(batch.column(at)):
                words = normal_words(text)
                spans, names = automaton.scan(words)
                counts.append(len(words))
                hits.append(spans)
                items.append(sorted(names))
            columns = [batch.column(i) for i in keep]
            columns += [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32())))]
            columns += [pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + list(MARKS))
            yield out.filter(pa.array([bool(h) for h in hits], pa.bool_())) if only_hit else out

    return run


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words and occurring items of every document."""
    hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda n, s: n + (s[1] - s[0]).cast("bigint"))
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def without_spans(text: str, hits: list[list[int]]) -> str:
    """The text without the hit words and what stands between words of one hit."""
    data = text.encode()
    places = [m.span() for m in WORDS.finditer(data.lower())]
    at, kept = 0, []
    for first, end in hits:
        kept.append(data[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_share: float = 0.5) -> DataFrame:
    """Documents without their hit spans; those with more than ``max_share`` of their words hit go as a whole."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    at = docs.columns.index(text_col)
    marked = mark(docs.toDF(*names), benchmark, names[at])
    hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda n, s: n + (s[1] - s[0]).cast("bigint"))
    kept = marked.where(hit <= max_share * F.col("_n_words")).select(*names, "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = batch.column(batch.num_columns - 1).to_pylist()
            texts = [without_spans(t, h) if h else t for t, h in zip(texts, hits)]
            new = list(batch.columns[:-1])
            new[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(new, names=names)

    return map_batches(kept, run, docs.toDF(*names).schema).toDF(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: ``report`` by windows as joined words, each looked up in every document.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0))),
grams AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs JOIN (SELECT DISTINCT k FROM windows) ON len(w) >= k)),
found AS (SELECT r, i, grams.k, item FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hits AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, i + unnest(range(0, k)) AS place FROM (SELECT DISTINCT r, i, k FROM found))
  GROUP BY r),
names AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits ON docs.r = hits.r LEFT JOIN names ON docs.r = names.r
"""
