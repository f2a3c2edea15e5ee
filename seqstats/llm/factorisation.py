"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's score is the logistic of a linear part and of low-rank pairwise interactions. With the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i x_i v_i|^2 - sum_i |x_i v_i|^2) / 2 the interactions cost as much as the linear part.

Null and empty texts have no words and are scored by their structure. A null character count counts as 0. Repeated rows are
scored each for itself. Without labels of both kinds every score is the share of label 1 seen (0.5 without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import WORD, batches_of, labelled_sample, map_batches, utf8

#: Labelled documents the machine learns from, at most.
SAMPLE_ROWS = 12_000
#: Hashed words have the indices below this; the structure's intervals and values come after them.
WORD_BUCKETS = 1 << 16
RANK = 8
PARTS, LEFT_OUT = 3, 1
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"!?;:,.", np.uint8)
#: Upper ends of the intervals that a structure statistic is dealt into.
_CUTS = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
STATISTICS = ("symbols", "marks", "capitals", "digits", "distinct words", "most frequent word", "doubled lines", "length", "characters")
SIZE = WORD_BUCKETS + len(STATISTICS) * (len(_CUTS) + 2)


def features(text: bytes, n_chars: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features. The words' values have the norm 1."""
    words = Counter(WORD.findall(text))
    n = sum(words.values())
    index = np.fromiter((crc32(w) & (WORD_BUCKETS - 1) for w in words), np.int64, len(words))
    value = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x]
    size = max(1, len(text))
    shares = np.array(
        [
            seen[_SYMBOLS].sum() / size, seen[_MARKS].sum() / size, seen[65:91].sum() / size, seen[48:58].sum() / size,
            len(words) / max(1, n), max(words.values(), default=0) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, np.log1p(n) / 14), min(1.0, np.log1p(max(0.0, n_chars)) / 16),
        ]
    )
    first = WORD_BUCKETS + np.arange(len(shares)) * (len(_CUTS) + 2)
    interval = first + np.searchsorted(_CUTS, shares)
    structure = np.concatenate([interval, first + len(_CUTS) + 1])
    return np.concatenate([index, structure]), np.concatenate([value, np.full(len(shares), 0.5), shares])


@dataclass
class Machine:
    """Bias, linear weights and factors of all features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def sums(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic and the factor sums of documents whose features begin at ``starts``."""
        weighted = self.factors[index] * value[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", weighted, weighted), starts)
        line = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + line + ((sums**2).sum(axis=1) - squares) / 2, sums

    def score(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not documents:
            return np.zeros(0)
        index, value, starts = stacked(documents)
        return 1 / (1 + np.exp(-np.clip(self.sums(index, value, starts)[0], -30, 30)))


def stacked(documents: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(i) for i, _ in documents])
    return np.concatenate([i for i, _ in documents]), np.concatenate([v for _, v in documents]), np.cumsum(lengths) - lengths


def fit(
    documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4,
    batch: int = 64, seed: int = 7,
) -> Machine:
    """Adagrad on the logistic loss, the two labels weighted alike by the square root of their frequency."""
    random = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, RANK)))
    if not len(y) or y.min() == y.max():
        return machine
    machine.factors = random.normal(0, 0.05, (SIZE, RANK))
    past_linear, past_factors, past_bias = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
    weight = np.where(y == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            index, value, starts = stacked([documents[i] for i in rows])
            lengths = np.diff(np.append(starts, len(index)))
            scores, sums = machine.sums(index, value, starts)
            error = np.repeat((1 / (1 + np.exp(-np.clip(scores, -30, 30))) - y[rows]) * weight[rows] / len(rows), lengths)
            used, place = np.unique(index, return_inverse=True)
            line = np.bincount(place, error * value, len(used)) + decay * machine.linear[used]
            each = (error * value)[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[index] * value[:, None])
            by = np.argsort(place, kind="stable")
            first = np.searchsorted(place[by], np.arange(len(used)))
            pair = np.add.reduceat(each[by], first, axis=0) + decay * machine.factors[used]
            slope = error[starts].sum() if len(starts) else 0.0
            past_linear[used] += line**2
            past_factors[used] += pair**2
            past_bias += slope**2
            machine.linear[used] -= rate * line / np.sqrt(past_linear[used])
            machine.factors[used] -= rate * pair / np.sqrt(past_factors[used])
            machine.bias -= rate * slope / np.sqrt(past_bias)
    return machine


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """The machine from at most ``rows`` labelled documents outside the held-out part; their features come to the driver."""
    sample = labelled_sample(documents.select("doc_id", "text", "n_chars"), labels, "quality", rows, PARTS, LEFT_OUT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [features((t or "").encode(), number(c)) for t, c in zip(frame["text"], frame["n_chars"])]
            yield pd.DataFrame(
                {
                    "index": [i.astype("<i4").tobytes() for i, _ in found],
                    "value": [v.astype("<f4").tobytes() for _, v in found],
                    "label": frame["_label"].to_numpy(),
                }
            )

    found = sample.select("text", "n_chars", "_label").mapInPandas(run, "index binary, value binary, label int").toPandas()
    pairs = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(found["index"], found["value"])]
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0].tobytes(), pairs[i][1].tobytes()))  # the same at every run
    return fit([pairs[i] for i in order], found["label"].to_numpy(float)[order])


def number(value) -> float:
    return 0.0 if value is None or value != value else float(value)


def scored(documents: DataFrame, machine: Machine) -> DataFrame:
    """Every document's ``held_out``, ``score`` (probability of quality 1) and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS
    source = documents.select("doc_id", F.coalesce(fold == LEFT_OUT, F.lit(False)).alias("held_out"), "text", "n_chars")
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, chars = utf8(batch.column(2)), batch.column(3).to_pylist()
            scores = [
                model.score([features(texts[i], number(chars[i])) for i in range(a, b)]) for a, b in batches_of(texts, 1_000_000)
            ]
            new = [batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *scores]))]
            yield pa.RecordBatch.from_arrays(new, names=["doc_id", "held_out", "score"])

    return map_batches(source, run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, train(documents, labels))
