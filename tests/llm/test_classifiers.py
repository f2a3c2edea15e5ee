"""Quality classifier and toxicity: identities, defined results and held-out accuracy."""

import zlib

import numpy as np
import pytest

from seqstats.llm import factorisation as f
from seqstats.llm import toxicity as t
from seqstats.llm.queries import op7_quality_classifier, op10_toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


@pytest.mark.parametrize("query, column, parts, left, least", [(op7_quality_classifier, "quality", 3, 1, 0.98), (op10_toxicity, "toxic", 4, 2, 0.88)])
def test_held_out(spark, query, column, parts, left, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = query(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == left) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.5 if column == "quality" else 0.3))
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) > least


def test_pairs_by_the_identity():
    random = np.random.default_rng(3)
    machine = f.Machine(0.3, random.normal(size=f.SIZE), random.normal(size=(f.SIZE, f.RANK)))
    documents = [f.features(x, 5) for x in (b"one two two three", b"", b"x | y # z")]
    found, _ = machine.sums(*f.stacked(documents))
    for (index, value), score in zip(documents, found):
        pairs = sum(
            machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j]
            for i in range(len(index))
            for j in range(i)
        )
        assert np.isclose(score, 0.3 + machine.linear[index] @ value + pairs)


@pytest.mark.parametrize("module", [f, t])
def test_nulls_repeats_and_missing_labels(spark, module):
    rows = [(1, "some words", 5), (1, "some words", 5), (2, None, None), (None, "", 0), (3, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 AS score", "2 AS index")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 1), (3, 1, 0)], none.schema)
    for labels in (none, some):
        got = module.report(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"]
        assert all(0 <= r.score <= 1 for r in got)
    assert module.report(docs.limit(0), none).count() == 0


def test_toxic_words_gain(spark):
    random = np.random.default_rng(2)
    made = ["".join(random.choice(list("abcdefghijklmnoprstu"), 7)) for _ in range(400)]

    def text(extra):
        words = list(random.choice(made, 60)) + extra * 3
        return " ".join(random.permutation(words)).encode()

    toxic = [text(["idiotic", "pathetic"]) for _ in range(60)]
    plain = [text(["sunshine", "gardening"]) if i % 2 else text([]) for i in range(300)]
    model = t.fit(toxic, plain, 0.1)
    assert b" idioti" in model.toxic and b" patheti" in model.toxic and b"sunsh" not in model.toxic
    scores = model.score([text(["idiotic", "pathetic"]), text(["sunshine", "gardening"]), b""])
    assert scores[0] > 0.5 > scores[1]


def test_dictionary_windows_come_from_all_documents(monkeypatch):
    """Long documents that sort first do not crowd out the others, and documents that share a word are no copies."""
    taken = []
    monkeypatch.setattr(t, "DICTIONARY_WINDOWS", 50)
    monkeypatch.setattr(t.zstandard, "train_dictionary", lambda size, samples, **_: taken.extend(samples) or t.zstandard.ZstdCompressionDict(b"".join(samples)))
    t.ordinary_content([b" ".join(b"aa%d" % i for i in range(4_000)).replace(b"0", b"x")] + [b"zz " * 8 + b"word%c " % (97 + i) * 8 for i in range(26)])
    assert len(taken) == 50
    t.ordinary_content([b" ".join(b"w" + bytes([97 + i % 26, 97 + i // 26 % 26, 97 + i // 676]) for i in range(k, k + 800)) for k in range(0, 8_000, 800)])
    kinds = {w.split()[0] for w in taken[50:]}
    assert len(kinds) == 50 and len({int(x[3]) for x in kinds}) > 5
    spelled = lambda i: b" ".join(bytes([97 + i % 26, 97 + i // 26 % 26, 97 + k, 97 + (i * 7 + k) % 26]) for k in range(12))
    toxic, plain = [b"accommodating insulting " + spelled(i) for i in range(90)], [b"accommodating friendly " + spelled(i) for i in range(90, 180)]
    assert b" insulting" in t.toxic_content(toxic, plain)
    assert t.toxic_content(toxic[:1] * 90, plain) == b""
