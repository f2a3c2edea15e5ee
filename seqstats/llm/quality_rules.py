"""Quality rules: counted base rules, then gradient-boosted trees over document statistics.

The trees are fitted on histograms of a bounded sample of labelled documents and flattened into numpy node arrays, so a
block of documents walks all trees at once. The share of symbols, repeated words, repeated lines and capitals can only
lower a document's quality (monotonic constraints).

Null and empty texts have no words and fail the base rules. Repeated rows are judged each for itself. Without labels of
both kinds the trees have no splits and keep what the base rules keep. Very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import WORD, labelled_sample, map_batches, utf8

#: Labelled documents the trees learn from, at most.
SAMPLE_ROWS = 20_000
WINDOW = 5
#: Statistics that the trees see, with the direction quality may take as they grow (0: either).
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "punctuation_share": -1, "digit_share": 0, "line_words": 0, "distinct_share": 0, "wide_share": 0,
}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.array([32, 9, 10, 11, 12, 13])
_UPPER, _DIGITS = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.frombuffer(b"!?;:,.", np.uint8)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Hashes name candidates, the words themselves decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    codes = codes ^ (codes >> np.uint64(29))
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys += codes[j : j + n] * _FACTORS[j % 5] * np.uint64(2 * (j // 5) + 1)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    member = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    seen: dict[tuple[bytes, ...], int] = {}
    places = order[member].tolist()
    for i in places:
        gram = tuple(words[i : i + window])
        seen[gram] = seen.get(gram, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    hits = [i for i in places if seen[tuple(words[i : i + window])] > 1]
    np.add.at(edge, hits, 1)
    np.add.at(edge, np.array(hits, np.int64) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def counted(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts of a text and the statistics for the trees."""
    words = WORD.findall(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(seen.sum() - seen[0x80:0xC0].sum())
    chars = points - int(seen[_SPACES].sum())
    symbols = int(seen[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    doubled = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    n = max(1, len(words))
    statistics = [
        np.log1p(len(words)), chars / n, symbols / max(1, chars), doubled / max(1, len(lines)), repeats / n,
        int(seen[_UPPER].sum()) / max(1, chars), int(seen[_MARKS].sum()) / max(1, chars),
        int(seen[_DIGITS].sum()) / max(1, chars), min(n / max(1, len(lines)), 1000.0), len(set(words)) / n,
        int(seen[0xC0:].sum()) / max(1, chars),
    ]
    return [len(words), chars, symbols, doubled, repeats], statistics


@dataclass
class Trees:
    """Boosted trees as node arrays: a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all rows and trees at once."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15,
    bins: int = 48, smooth: float = 1.0, least: float = 2.0,
) -> Trees:
    """Trees for the logistic loss. ``directions``: per feature 1 (the score may only rise with it), -1 (only fall) or 0.

    A split that would break a feature's direction is not made, and the middle between its sides bounds everything
    below either side, so the direction holds in the whole tree and in their sum.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else None
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1.0
    start = float(np.log(share / (1 - share))) if 0 < share < 1 else 10.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    f = np.full(len(y), start)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + smooth), low, high))
        nodes.append([0, np.inf, at, at, weight * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                part = binned[rows, j]
                gl = np.cumsum(np.bincount(part, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(part, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(part, minlength=len(e) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                wl = np.clip(-gl / (hl + smooth), low, high)
                wr = np.clip(-gr / (hr + smooth), low, high)
                gain = -(gl * wl + (hl + smooth) * wl**2 / 2 + gr * wr + (hr + smooth) * wr**2 / 2)
                gain += total_g * weight + (total_h + smooth) * weight**2 / 2
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                if directions[j]:
                    gain[directions[j] * (wr - wl) < 0] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, (wl[k] + wr[k]) / 2))
        if best[1]:
            j, k, middle = best[1]
            goes = binned[rows, j] <= k
            bounds = [(low, high), (low, high)]
            if directions[j] > 0:
                bounds = [(low, middle), (middle, high)]
            elif directions[j] < 0:
                bounds = [(middle, high), (low, middle)]
            nodes[at][:2] = [j, edges[j][k]]
            nodes[at][2] = grow(rows[goes], level + 1, *bounds[0])
            nodes[at][3] = grow(rows[~goes], level + 1, *bounds[1])
        return at

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
            node = np.full(len(y), first)
            for _ in range(depth):
                a = np.array(nodes)
                which = a[node, 0].astype(int)
                down = x[np.arange(len(y)), which] <= a[node, 1]
                node = np.where(down, a[node, 2], a[node, 3]).astype(int)
            f += np.array(nodes)[node, 4]
    a = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    return Trees(
        a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots or [0]), depth, start
    )


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_counts`` (base counts) and ``_statistics`` (for the trees)."""
    names, at = df.columns, df.columns.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", _counts array<bigint>, _statistics array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [counted(t) for t in utf8(batch.column(at))]
            new = [pa.array([c for c, _ in both], pa.list_(pa.int64())), pa.array([s for _, s in both], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "_counts", "_statistics"])

    return map_batches(df, run, schema)


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents; only their statistics come to the driver."""
    sample = labelled_sample(documents.select("doc_id", "text"), labels, "quality", rows).select("text", "_label")
    found = statistics(sample).select("_label", "_statistics").toPandas()
    x = np.array(found["_statistics"].tolist(), float).reshape(len(found), len(STATISTICS))
    return fit(x, found["_label"].to_numpy(float), list(STATISTICS.values()))


def judged(df: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows with base counts, ``base_failed``, the trees' ``quality`` and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(trees)
    names, at = df.columns, df.columns.index(text_col)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", {n} bigint" for n in added)
    schema += ", base_failed boolean, quality double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            both = [counted(t) for t in utf8(batch.column(at))]
            counts = np.array([c for c, _ in both], np.int64).reshape(len(both), len(added))
            x = np.array([s for _, s in both], float).reshape(len(both), len(STATISTICS))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            quality = model.score(x)
            new = [*(pa.array(counts[:, j]) for j in range(len(added))), pa.array(failed), pa.array(quality)]
            new.append(pa.array(~failed & (quality >= 0.5)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *added, "base_failed", "quality", "kept"])

    return map_batches(df, run, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict of every document."""
    return judged(documents.select("doc_id", "text"), train(documents, labels)).drop("text")


def keep(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged; learned from ``documents`` and ``labels``."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    kept = judged(renamed, train(documents, labels), text).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
