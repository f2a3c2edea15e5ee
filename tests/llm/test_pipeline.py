"""The pipeline's stages, each on its own input, against the operators' definitions."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from seqstats.llm import decontamination as d
from tests.llm.test_simhash import brute_components, brute_print

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and every stage's result, written and read again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names[0].startswith("quality") and len(names) == 5
    for df in steps[1:5]:
        assert df.columns == steps[0].columns
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert all(before[i] == t for i, t in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    junk = [i for i in before if labels.get(i) == 0]
    assert not any(i in after for i in junk)
    long = [i for i in before if labels.get(i) == 1 and len(before[i].split()) >= 60]
    assert np.mean([i in after for i in long]) > 0.95


def test_near_duplicates(steps):
    before, after = texts(steps[1]), texts(steps[2])
    root = brute_components([brute_print(t) for t in before.values()])
    least = {}
    for i, t in before.items():
        r = root[brute_print(t)]
        least[r] = min(i, least.get(r, i))
    assert after == {i: before[i] for i in least.values()}


def test_decontamination(spark, steps):
    before, after = texts(steps[2]), texts(steps[3])
    items = [d.normal_words(r.text.encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(x[i : i + 10]) for x in items for i in range(len(x) - 9)}
    for i, text in before.items():
        w = d.normal_words(text.encode())
        hit = np.zeros(len(w), bool)
        for a in range(len(w) - 9):
            if tuple(w[a : a + 10]) in windows:
                hit[a : a + 10] = True
        if not hit.any():
            assert after[i] == text
        elif 2 * hit.sum() <= len(w):
            assert d.normal_words(after[i].encode()) == [x for x, h in zip(w, hit) if not h]
        else:
            assert i not in after


def test_secrets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    secret = re.compile(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|AKIA[A-Z0-9]{16}')
    assert after == {i: secret.sub("[SECRET]", t) for i, t in before.items()}
    assert any("[SECRET]" in t for t in after.values())


def test_encoding(steps):
    before = texts(steps[4])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    for r in rows:
        ids = library.encode_ordinary(before[r.doc_id])
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_run(spark, steps):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
        assert stage(spark, odd, FOLDER).columns == docs.columns
    assert corpus_pipeline.quality(spark, odd, FOLDER).count() == 0
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, odd, FOLDER).count() == 2
