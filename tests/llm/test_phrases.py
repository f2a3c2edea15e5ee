"""Phrase mining against counting every phrase of every piece."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstats.llm import phrases as p

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, least, longest, top, percent=100):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {x: a for x, a in counts.items() if a >= least}
    rows = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        longer = [b for (other, w), b in frequent.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(words), a, left, right, totals[lang], score))
    out = []
    for lang in {x[0] for x in rows}:
        ranked = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, i, *x[1:]) for i, x in enumerate(ranked[:top], 1)]
    return sorted(out)


def made(seed, rows=60):
    r = np.random.default_rng(seed)
    words = ["the", "of", "New", "york", "city", "é", "x1", "hall", "a#b", "z"]
    docs = []
    for i in range(rows):
        n = int(r.integers(0, 60))
        text = "".join(str(r.choice(words, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) + str(r.choice([" ", " ", " ", "\t", ". ", ",", "\n"])) for _ in range(n))
        docs.append((["en", "de", None, "und"][int(r.integers(4))], text + " new york city hall of the" * int(r.integers(0, 3))))
    return docs + [("en", None), ("en", ""), (None, "  \t. ;"), *[("en", "New York City Hall. of the")] * 20]


@pytest.mark.parametrize("budget", [1 << 20, 64, 8])
def test_against_counting(spark, monkeypatch, tmp_path, budget):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = made(1)
    frame = spark.createDataFrame([(i, *x, "n") for i, x in enumerate(docs)], "key int, lang string, text string, phrase string").repartition(5)
    found = p.phrases(frame, least=4, longest=5, top=30, budget=budget, bits=1 << 12)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(docs, 4, 5, 30)


def test_part_of_cover_and_shared_bits(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = made(2)
    frame = spark.createDataFrame(docs, "lang string, text string")
    found = p.phrases(frame, least=3, longest=4, top=1000, percent=60, budget=100, bits=64)
    assert sorted(map(tuple, found.collect())) == brute(docs, 3, 4, 1000, 60)


def test_prefixes_are_lengthened(spark, tmp_path):
    """A pair that is too frequent for a group is lengthened until its parts fit, and groups get all suffixes of their prefixes."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = spark.createDataFrame([("en", "a b c d e f")] * 50 + [("en", "a b x y z")] * 30, "lang string, text string")
    words = p.word_counts(docs)
    partition = p.partitioned(docs, words, 5, 5, 8 * 60, 1 << 16)
    text = p.Numbered([b"a b c d e f"], "en")
    levels = {depth: (at.tolist(), reach.tolist()) for depth, _, at, reach in partition.placed(text, 5)}
    assert levels == {2: ([0, 1, 2, 3, 4], [2, 4 + 1, 4, 3, 2]), 3: ([0], [5])}


def test_long_text_and_empty_table(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    frame = spark.createDataFrame([("en", "one two three " * 100_000)], "lang string, text string")
    rows = [tuple(r) for r in p.phrases(frame, least=100).collect()]
    assert rows == brute([("en", "one two three " * 100_000)], 100, 5, 2000)
    assert p.phrases(frame.limit(0)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, size int, a long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert p.scored(counts, totals, 100).collect()[0]["score"] == 1000 * (big - 7) * 9 * big // (big * (big - 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB .\t\né", max_size=30), max_size=4))
def test_tokens(texts):
    wanted = []
    for text in texts:
        for piece in re.split("[.\n]", text):
            wanted.append([w.replace("B", "b").encode() for w in re.findall("[^ \t]+", piece)])
    found = [[]]
    for word in p.tokens([x.encode() for x in texts]):
        found[-1].append(word) if word != b"." else found.append([])
    assert [x for x in found if x] == [x for x in wanted if x]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(-1, 2), st.integers(1, 5)), max_size=20))
def test_subtree(rows):
    leaves = np.array([(0, a, b, c) for a, b, c, _ in rows], np.int32).reshape(-1, 4)
    tree = p.Subtree.build(leaves, np.full(len(rows), 2), np.array([x[3] for x in rows], np.int64))
    found = {}
    for depth, starts, counts in tree.nodes():
        for leaf, n in zip(tree.leaves[starts], counts):
            if n:
                found[tuple(leaf[1 : depth + 1].tolist())] = int(n)
    wanted = Counter()
    for a, b, c, n in rows:
        wanted[a, b] += n
        if c >= 0:
            wanted[a, b, c] += n
    assert found == dict(wanted)
