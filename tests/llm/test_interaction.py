"""The filter audit against running every order of the filters over every document."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from seqstats.llm import interaction as x


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 1000)), max_size=40))
def test_bit_counts(rows):
    words, runs = np.array([w for w, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)
    wanted = [sum(n for w, n in rows if w >> bit & 1) for bit in range(32)]
    assert x.bit_counts(words, runs, 32).tolist() == wanted


def test_many_words():
    words = np.random.default_rng(1).integers(0, 2**32, 10_000, dtype=np.uint64)
    wanted = [int((words >> np.uint64(i) & np.uint64(1)).sum()) for i in range(32)]
    assert x.bit_counts(words, np.ones(len(words), np.int64), 32).tolist() == wanted


def test_truth_table():
    for failed in range(32):
        word = x.truth_table(failed, 5)
        assert [word >> s & 1 for s in range(32)] == [int(not s & failed) for s in range(32)]


texts = st.text(alphabet="aB C\n\t\x0bé#&Z ", max_size=200)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wanted = (
        (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        + 8 * bool(re.search("[#$%&*|]", text))
    )
    assert x.failures(text.encode()) == wanted


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails = []
    for i, text, part in docs:
        text = text or ""
        bits = x.failures(text.encode()) | 16 * (i is not None and i > first[text])
        fails.append(({f for f in range(5) if bits >> f & 1}, part or "", i in good, i in toxic))
    rows = set()
    for part in {p for _, p, _, _ in fails}:
        inside = [r for r in fails if r[1] == part]
        removed_by = dict.fromkeys(range(5), 0)
        steps = []
        for order in itertools.permutations(range(5)):
            left = inside
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in inside) - len(out)
                left = [r for r in left if f not in r[0]]
                removed_by[f] += len(out)
                unique = sum(r[0] == {f} for r in inside)
                steps.append((f, ["".join("ABCDE"[y] for y in order), step, len(left), len(out), redundant, unique, sum(r[2] for r in out), sum(r[3] for r in out)]))
        rows |= {(part, *row, removed_by[f]) for f, row in steps}
    return rows


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(3)
    kinds = ["", "plain " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)), "short # one", " ".join(f"v{i}" for i in range(70)) + " $"]
    docs = [(int(i), str(kinds[int(r.integers(6))]), str(r.choice(["s1", "s2", "é"]))) for i in r.integers(0, 200, 300)]
    docs += [(None, kinds[1], "s1"), (None, None, None), (5, None, None), (3, "", ""), (-4, "only", "s9"), (-4, "only", "s9"), (50, "only", "s9"), (60, "x " * 300_000, "s9")]
    labels = [(int(i), [None, 0, 1][int(r.integers(3))], [None, 0, 1][int(r.integers(3))]) for i in r.integers(0, 200, 150)] + [(None, 1, 1)]
    return docs, labels


def test_against_every_order(spark, made):
    docs, labels = made
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("failed", F.lit("x")).repartition(6)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("y"))
    found = {tuple(r) for r in x.report(frame, known).collect()}
    assert found == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert x.report(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert x.report(one, labels).count() == 600
