"""Decontamination against windows looked up one by one."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import check
from seqstats.llm import decontamination as d
from seqstats.llm.queries import ORACLES, op8_decontamination

FOLDER = "/root/testdata/sf0.001"


def brute(items, words, window):
    """Hit flags and items, from every window of every item."""
    flags, found = [0] * len(words), set()
    for name, item in items:
        size = min(window, len(item))
        for j in range(len(item) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[j : j + size]:
                    flags[i : i + size] = [1] * size
                    found.add(name)
    return flags, found


def flags_of(spans, n):
    flags = [0] * n
    for a, b in spans:
        assert a < b
        flags[a:b] = [1] * (b - a)
    return flags


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=5), st.lists(words, max_size=3), st.integers(1, 5))
def test_automaton(items, documents, window):
    items = [(str(i), x) for i, x in enumerate(items)]
    automaton = d.Automaton(items, window)
    for document in documents:
        spans, names = automaton.scan(document)
        assert (flags_of(spans, len(document)), names) == brute(items, document, window)
        assert spans == d.joined(spans)


def test_words():
    assert d.normal_words("Ab-C é9_x".encode()) == [b"ab", b"c", "é9".encode(), b"x"]


def test_frame_blocks_and_nulls(spark, monkeypatch, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(d, "BLOCK_BYTES", 12)
    long = "q w e r t y u i o p a s"
    items = spark.createDataFrame([(1, "one two"), (1, long), (None, "x y z"), (3, None), (4, "")], "item_id int, text string")
    rows = [(1, f"s {long} ONE; two x"), (2, None), (2, ""), (None, "x Y z"), (5, "w e r t y u i o p a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.report(docs, items).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {
        (1, 16, 14, 1, sha("1"), True), (2, 0, 0, 0, sha(""), False), (None, 3, 3, 1, sha("null"), True),
        (5, 10, 10, 1, sha("1"), True),
    }
    assert d.report(docs.limit(0), items).count() == 0
    assert d.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_twenty_blocks(spark, monkeypatch):
    """The table's items in many blocks give what one block gives; the texts are written once."""
    docs, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    one = sorted(map(tuple, d.report(docs, items).collect()))
    cleaned = sorted(map(tuple, d.clean(docs, items).collect()))
    size = sum(len((r.text or "").encode()) for r in items.distinct().collect())
    monkeypatch.setattr(d, "BLOCK_BYTES", size // 19)
    labels = []
    monkeypatch.setattr(d, "written", lambda df, label, kept=d.written: (labels.append(label), kept(df, label))[1])
    assert d.item_blocks(items, "item_id", "text")[1] >= 20
    assert sorted(map(tuple, d.report(docs, items).collect())) == one and labels == ["numbered"]
    assert sorted(map(tuple, d.clean(docs, items).collect())) == cleaned


def test_very_long_text_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    passage = "ten words of an item that stand in long texts"
    items = spark.createDataFrame([(i, f"{passage} {i}") for i in range(4)], "item_id int, text string")
    rows = [(1, "x " * 500_000 + passage + " 2 " + "y " * 500_000, "a")] * 2 + [(2, "y " * 50, "b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in d.report(docs, items).collect()]
    assert sorted(got) == [(1, 1_000_011, 11, 4)] * 2 + [(2, 50, 0, 0)]
    assert sorted((r.doc_id, len(r.text), r["_row"]) for r in d.clean(docs, items).collect()) == [(1, 2_000_001, "a")] * 2 + [(2, 100, "b")]


def test_clean_removes_spans_and_mostly_hit_documents(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    rows = [(1, "a b ÉONE, Two three. ONE, Two three! c d", 7), (2, "one two three x", 8), (3, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _hits int")
    got = sorted(tuple(r) for r in d.clean(docs, items).collect())
    assert got == [(1, "a b ÉONE, Two three. ! c d", 7), (3, None, 9)]


def test_query(spark):
    items = [(str(r.item_id), d.normal_words(r.text.encode())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    where = {}
    for name, item in items:
        for j in range(max(0, len(item) - 9)):
            where.setdefault(tuple(item[j : j + 10]), set()).add(name)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op8_decontamination(spark, FOLDER).collect()
    assert len(got) == len(texts) and sum(r.contaminated for r in got) > 0
    for r in got:
        w = d.normal_words(texts[r.doc_id].encode())
        flags, found = [0] * len(w), set()
        for i in range(len(w) - 9):
            if names := where.get(tuple(w[i : i + 10])):
                flags[i : i + 10] = [1] * 10
                found |= names
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), sum(flags), len(found))
        assert r.items_sha256 == d.digest(list(found)) and r.contaminated == bool(found)


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert check.compare(spark, check.connect(folder), folder, "op8_decontamination", ORACLES["op8_decontamination"]) is None
