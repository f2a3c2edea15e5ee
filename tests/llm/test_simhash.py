"""SimHash near-duplicates against all pairs and a plain search of components."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstats.llm import simhash as s
from seqstats.llm.queries import op9_simhash_near_dedup

FOLDER = "/root/testdata/sf0.01"


def brute_print(text, shingle=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """The least member of every fingerprint's component, all pairs compared."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÀÉ \n Z", max_size=60), st.integers(1, 5))
def test_fingerprint(text, shingle):
    assert s.fingerprint(text.encode(), shingle) == brute_print(text, shingle)


def test_every_four_places_hold_a_triple():
    assert len(s.triples()) == len(set(s.triples())) == 20
    assert all(any(set(t) <= set(q) for t in s.triples()) for q in itertools.combinations(range(8), 4))


def clusters(seed, size=30, chains=12):
    """Random fingerprints, some of them chains of small steps."""
    random = np.random.default_rng(seed)
    found = []
    for _ in range(size):
        p = int(random.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(random.integers(1, chains))):
            found.append(p)
            for bit in random.integers(0, 64, int(random.integers(1, 6))):
                p ^= 1 << int(bit)
    return found


@pytest.mark.parametrize("long, short", [(4096, 48), (3, 2)])
def test_components(spark, monkeypatch, long, short):
    monkeypatch.setattr(s, "LONG_LIST", long)
    monkeypatch.setattr(s, "SHORT_LIST", short)
    prints = clusters(5)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in set(prints)]
    links = s.links(spark.createDataFrame(signed, "fp long"))
    assert links.count() < 20 * len(signed)
    root = {r.fp: r.root for r in s.components(links).collect()}
    want = brute_components(prints)
    groups = {}
    for (p,) in signed:
        groups.setdefault(root.get(p, p), set()).add(p % 2**64)
    expected = {}
    for p, r in want.items():
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_lists_in_one_batch():
    prints = np.array(sorted({p | (7 << 60) for p in range(3000)}), np.uint64)
    a, b = s.forest(np.zeros(len(prints), np.int64), prints)
    assert len(a) == len(prints) - 1 and set(b) == {prints[0]}


def test_frame(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, 1), (7, base, 2), (7, base, 2), (9, None, 3), (8, "", 4), (None, base, 5), (3, "other words here today", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in s.report(docs).collect())
    zero, one = "0" * 16, format(brute_print(base), "016x")
    assert got == sorted([
        ("5", one, 5), ("7", one, 5), ("7", one, 5), ("9", zero, 8), ("8", zero, 8), ("None", one, 5),
        ("3", format(brute_print("other words here today"), "016x"), 3),
    ])
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.fp for r in kept.collect()) == [1, 4, 6]
    assert s.report(docs.limit(0)).count() == 0 and s.keep_one(docs.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    root = brute_components(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op9_simhash_near_dedup(spark, FOLDER).collect()}
    assert got == {(i, format(p, "016x"), least[root[p]]) for i, p in prints.items()}
