"""Quality rules: counts against brute force, the trees' directions and held-out accuracy."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstats.llm import quality_rules as q
from seqstats.llm.queries import op2_quality_rules

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    flags = [0] * len(words)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, gram in enumerate(grams):
        if grams.count(gram) > 1:
            flags[i : i + 5] = [1] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(flags)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#\n\t\x0b|€", max_size=120))
def test_counts(text):
    assert q.counted(text.encode())[0] == brute(text)


def test_trees_keep_directions():
    random = np.random.default_rng(1)
    x = random.random((800, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) - x[:, 1] + random.normal(0, 0.3, 800)) > 0).astype(float)
    trees = q.fit(x, y, [1, -1, 0], depth=4)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.8
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(random.random((40, 1, 3)), 60, axis=1)
        grid[:, :, j] = np.linspace(-0.1, 1.1, 60)
        scores = trees.score(grid.reshape(-1, 3)).reshape(40, 60)
        assert (sign * np.diff(scores, axis=1) >= -1e-12).all()


def test_without_both_labels():
    assert (q.fit(np.zeros((0, 2)), np.zeros(0), [0, 0]).score(np.zeros((1, 2))) > 0.5).all()
    assert (q.fit(np.ones((4, 2)), np.zeros(4), [0, 0]).score(np.zeros((1, 2))) < 0.5).all()


def test_frame_and_keep(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, 1), (2, None, 2), (3, "", 3), (1, good, 4), (None, "same words again " * 20, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in q.report(docs, none).collect()}
    assert got == {(1, 30, False, True), (2, 0, True, False), (3, 0, True, False), (None, 60, True, False)}
    kept = q.keep(docs, docs, none)
    assert kept.columns == docs.columns and sorted(r.kept for r in kept.collect()) == [1, 4]
    assert q.keep(docs.limit(0), docs, none).count() == 0


def test_query_counts_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = {r.doc_id: r for r in op2_quality_rules(spark, FOLDER).collect()}
    for r in docs.collect():
        if r.n_chars < 3000:
            g = got[r.doc_id]
            assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == brute(r.text)
            failed = g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words
            assert g.base_failed == failed and not (failed and g.kept)
    trees = q.train(docs, labels.where("doc_id % 3 != 0"))
    held = labels.where("doc_id % 3 = 0").select("doc_id", labels["quality"].alias("label"))
    scored = q.judged(docs.select("doc_id", "text"), trees).join(held, "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == r.label for r in scored]) > 0.97
