"""The trie against dictionaries of counts; coded sequences against plain arrays."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstats.llm import lm_scoring as lm
from seqstats.llm.elias_fano import EliasFano
from seqstats.llm.queries import op6_lm_scoring

FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=300), st.lists(st.integers(0, 2**51), max_size=40), st.integers(0, 40))
def test_sequence(values, wanted, shift):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    coded = EliasFano.from_arrays(*EliasFano.of(values).arrays())
    assert (coded[np.arange(len(values))] == values).all()
    wanted = np.concatenate([np.array(wanted, np.uint64) >> np.uint64(shift), values])
    place, found = coded.find(wanted)
    assert (place == np.searchsorted(values, wanted)).all()
    assert (found == np.isin(wanted, values)).all()


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Brute:
    def __init__(self, texts):
        self.words, self.pairs, self.contexts, self.kinds = Counter(), Counter(), Counter(), Counter()
        for text in texts:
            t = tokens(text)
            self.words.update(t)
            self.pairs.update(zip(t, t[1:]))
        for (a, _), n in self.pairs.items():
            self.contexts[a] += n
            self.kinds[a] += 1
        self.n, self.v = sum(self.words.values()), len(self.words)

    def scores(self, text):
        t = tokens(text)
        base = [(self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1)) for w in t]
        score = base[:1]
        for a, b, p in zip(t, t[1:], base[1:]):
            if c := self.contexts[a]:
                p = max(self.pairs[a, b] - 0.75, 0) / c + 0.75 * self.kinds[a] / c * p
            score.append(p)
        return len(t), sum(self.words[w] > 0 for w in t), sum(map(math.log10, base)), sum(map(math.log10, score))


def check_rows(got, rows, brute):
    for r, text in rows:
        n, known, base, score = brute.scores(text)
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, abs=2e-4 * n)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    brute = Brute(t for i, t in texts.items() if not held(i))
    got = op6_lm_scoring(spark, FOLDER).collect()
    assert len(got) == len(texts) and {r.train_tokens for r in got} == {brute.n}
    assert all(r.held_out == held(r.doc_id) for r in got) and any(r.held_out for r in got)
    check_rows(got, [(r, texts[r.doc_id]) for r in got], brute)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("shard, block, gathered, cut", [(24_000_000, 500_000, 6_000_000, 8_000_000), (40, 3, 4, 8_000_000), (40, 3, 4, 2), (24_000_000, 500_000, 6_000_000, 9)])
def test_cases(spark, monkeypatch, shard, block, gathered, cut):
    monkeypatch.setattr(lm, "SLICE_TOKENS", cut)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "GATHERED", gathered)
    rows = [(1, "A b a b c"), (2, None), (3, ""), (1, "A b a b c"), (None, "x y\tz \n a b c d e f g"), (4, "one " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS score")
    trie = lm.train(docs)
    got = lm.scored(docs, trie).collect()
    brute = Brute(t for _, t in rows)
    assert trie.tokens == brute.n and trie.distinct == brute.v
    check_rows(got, list(zip(got, [t for _, t in rows])), brute)
    other = lm.scored(spark.createDataFrame([(9, "b unseen c a unseen")], "doc_id long, text string"), trie).collect()
    check_rows(other, [(other[0], "b unseen c a unseen")], brute)


def test_a_frequent_word_is_cut_into_slices(spark, monkeypatch):
    """A word that is half of all tokens: its successors are in several files, none with more than its part."""
    monkeypatch.setattr(lm, "SLICE_TOKENS", 500)
    texts = [" ".join(f"the w{(7 * i + j) % 900}" for j in range(40)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    trie = lm.train(docs)
    assert trie.slices.tolist() == [0, 1 + 8_100 // 500]
    brute, files = Brute(texts), [trie.file("pairs", k) for k in range(trie.slices[-1])]
    assert sum(len(f["probability"]) for f in files) == len(brute.pairs)
    hot = trie.lookup(np.array([lm.hash_of(b"the")], np.uint64))[0]
    of_hot = [int((lm.mapped(f, "start")[hot + 1] - lm.mapped(f, "start")[hot])[0]) for f in files]
    assert sum(of_hot) == brute.kinds["the"] and max(of_hot) < 2 * brute.kinds["the"] / len(files)
    got = lm.scored(docs, trie).collect()
    check_rows(got, [(r, texts[r.doc_id]) for r in got], brute)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.report(docs).count() == 0
    trie = lm.train(docs)
    r = lm.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), trie).first()
    assert (r.n_tokens, r.n_known) == (3, 0) and r.score == pytest.approx(r.base_score)
