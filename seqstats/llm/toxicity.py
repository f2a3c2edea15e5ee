"""Toxicity by compression distance: windows of words compressed with an ordinary and with a toxic zstandard dictionary.

The ordinary dictionary is trained on windows of ordinary documents. The toxic one holds the same content and after it the
word beginnings that tell toxic documents from ordinary ones, so a window compresses better with it only where it has such
words. A document's shares of windows that gain some bytes go into a calibrated logistic score.

Null and empty texts are one empty window. Repeated rows are scored each for itself. Without labels of both kinds every
score is the share of toxic labels seen (0 without any). Very long texts are compressed window by window.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import labelled_sample, map_batches, utf8

#: Labelled documents of each kind that the dictionaries and the calibration learn from, at most.
SAMPLE_ROWS = 3_000
PARTS, LEFT_OUT = 4, 2
THRESHOLD = 0.3
WINDOW = 8
ORDINARY_BYTES, TOXIC_BYTES = 8_192, 2_048
#: Windows of the sampled documents that the ordinary dictionary is trained on, at most, drawn by hash.
DICTIONARY_WINDOWS = 100_000
#: Documents that agree in so many least hashes of their words count once for the toxic dictionary.
COPY_HASHES = 8
#: Standard deviations by which the log odds of a telling beginning differ from 0, at least.
LEAST_DEVIATIONS = 3.3
GAINS = (1, 2, 3, 4, 5)
WORDS = re.compile(rb"[a-z\x80-\xff]+")


def windows(text: bytes) -> list[bytes]:
    """Consecutive windows of lower-case words, spaces around each word."""
    words = WORDS.findall(text.lower())
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words)), WINDOW)]


@dataclass
class Classifier:
    """Both dictionaries' contents and the weights of the calibrated score."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(GAINS) + 3))

    def __post_init__(self):
        self.coders: tuple | None = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "coders": None}

    def gains(self, text: bytes) -> np.ndarray:
        """By how many bytes the toxic dictionary shortens each window more than the ordinary one."""
        if self.coders is None:
            self.coders = tuple(coder(x).compress for x in (self.ordinary, self.ordinary + self.toxic))
        plain, toxic = self.coders
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)])

    def features(self, text: bytes) -> np.ndarray:
        """Shares of windows that gain so many bytes, the largest gains, and the number of windows."""
        gains = self.gains(text)
        best = np.sort(gains)[-3:]
        shares = [np.sqrt((gains >= g).mean()) for g in GAINS]
        return np.array([1.0, *shares, best.mean() / 5, np.log1p(len(gains)) / 5])

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def coder(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that finds every match of four bytes or more in its dictionary and writes no headers it can do without."""
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=4, hash_log=14, chain_log=14, search_log=4, window_log=15, target_length=8,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=parameters)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Word beginnings of toxic documents that tell them from ordinary ones, the most frequent last.

    Every word that has telling beginnings (in significantly more toxic documents than the rest) gives its best one, the one
    that most of them have, and its longest one, so that words are matched as far as they are known.
    """

    def beginnings(text: bytes) -> set[bytes]:
        return {w[:k] for w in set(WORDS.findall(text.lower())) for k in range(4, min(len(w), 24) + 1)}

    def counted(texts: list[bytes]) -> tuple[Counter, int]:
        """Documents by beginning; near copies, told by several least hashes of their words, count once."""
        counts, seen, n = Counter(), set(), 0
        for text in texts:
            parts = beginnings(text)
            key = tuple(heapq.nsmallest(COPY_HASHES, map(crc32, set(WORDS.findall(text.lower())))))
            if len(key) < COPY_HASHES or key not in seen:
                seen.add(key)
                counts.update(parts)
                n += 1
        return counts, n

    (here, n_here), (there, n_there) = counted(toxic), counted(ordinary)
    telling = {}
    for part, n in here.items():
        m = there[part]
        odds = np.log((n + 0.5) / (n_here + 1)) - np.log((m + 0.5) / (n_there + 1))
        if odds > 1.5 and odds > LEAST_DEVIATIONS * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)):
            telling[part] = n * odds
    chosen = Counter()
    for text in toxic:
        for word in WORDS.findall(text.lower()):
            if found := [word[:k] for k in range(4, min(len(word), 24) + 1) if word[:k] in telling]:
                chosen[max(found, key=lambda p: (telling[p], len(p), p))] += 1
                chosen[found[-1]] += 1
    parts: list[bytes] = []
    size = 0
    for part, _ in sorted(chosen.items(), key=lambda x: (-x[1], x[0])):
        if size + len(part) < TOXIC_BYTES and part not in parts:
            parts.append(part)
            size += len(part) + 1
    return b"".join(b" " + p for p in reversed(parts))


def ordinary_content(texts: list[bytes]) -> bytes:
    """The content of a dictionary trained on windows of ordinary documents.

    Of more than ``DICTIONARY_WINDOWS`` windows those of least hash are taken, whichever documents they are from. Of the dictionary its first
    tenth is left away: its tables (at most some hundred bytes), and the segments that the trainer valued least.
    """
    samples = heapq.nsmallest(DICTIONARY_WINDOWS, (w for text in texts for w in windows(text)), key=lambda w: (crc32(w), w))
    try:
        dictionary = zstandard.train_dictionary(ORDINARY_BYTES, samples, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: they are the dictionary
        dictionary = b"".join(samples)
    return dictionary[-ORDINARY_BYTES * 9 // 10 :]


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + decay * len(y) * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (p - y) + decay * len(y) * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Classifier:
    """Dictionaries from two thirds of the documents, calibration from the rest; ``share`` of all documents are toxic."""
    learn = lambda texts: [t for i, t in enumerate(texts) if i % 3 != 1]
    model = Classifier(ordinary_content(learn(ordinary)), toxic_content(learn(toxic), learn(ordinary)))
    if not toxic or not ordinary:
        model.weights[0] = 30.0 if toxic else -30.0
        return model
    texts = toxic[1::3] + ordinary[1::3]
    y = np.array([1.0] * len(toxic[1::3]) + [0.0] * len(ordinary[1::3]))
    if not 0 < y.sum() < len(y):  # too few to keep some back
        texts, y = toxic + ordinary, np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    x = np.array([model.features(t) for t in texts])
    model.weights = logistic(x, y)
    # the sample holds the kinds in another proportion than the labels do
    sampled = float(y.mean())
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    model.weights[0] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return model


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    """Learns from at most ``rows`` toxic and as many ordinary documents outside the held-out part."""
    source = documents.select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS
    share = labels.where(fold != LEFT_OUT).agg(F.avg(F.col("toxic").cast("double"))).first()[0]

    def texts(value: int) -> list[bytes]:
        sample = labelled_sample(source, labels, "toxic", rows, PARTS, LEFT_OUT, value)
        return sorted((r.text or "").encode() for r in sample.select("text").toLocalIterator())

    return fit(texts(1), texts(0), share or 0.0)


def scored(documents: DataFrame, model: Classifier) -> DataFrame:
    """Every document's ``held_out``, ``score`` (probability of being toxic) and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS
    source = documents.select("doc_id", F.coalesce(fold == LEFT_OUT, F.lit(False)).alias("held_out"), "text")
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            new = [batch.column(0), batch.column(1), pa.array(classifier.score(utf8(batch.column(2))))]
            yield pa.RecordBatch.from_arrays(new, names=["doc_id", "held_out", "score"])

    return map_batches(source, run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, train(documents, labels))
