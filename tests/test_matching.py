"""Matching and hierarchy against brute force on random sequences."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seqstats.functions.moves import token_count
from seqstats.operators import matching
from seqstats.operators.hierarchy import SIX_COUNTS, base_nodes, opening_intervals, prefix_closure, prefix_edges, rollup_counts
from seqstats.operators.matching import (
    deepest_match,
    exact_sequence_lookup,
    match_by_name_and_prefix,
    match_prefixes,
)


def starts(sequence, prefix):
    return (sequence + " ").startswith(prefix + " ")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    pick = lambda longest: " ".join(rng.choice("ab") + rng.choice(["", "1"]) for _ in range(rng.randint(1, longest)))
    games = [(f"p{rng.randrange(6)}", f"p{rng.randrange(6)}", pick(6), rng.choice(["1-0", "0-1", "*"])) for _ in range(300)]
    games += [("hot", "hot2", "a b a", "1-0")] * 200 + [("p1", "p2", None, "1-0")]
    openings = {pick(5) for _ in range(40)} | {"a", "a b"}
    # Two ids share a sequence; the greater one is the deeper.
    return games, [(m.replace(" ", "_"), m, f"N{len(m)}") for m in openings] + [("a_again", "a", "N1")]


@pytest.fixture(scope="module")
def frames(spark, data):
    games = spark.createDataFrame(data[0], "white STRING, black STRING, moves STRING, result STRING")
    return games, spark.createDataFrame(data[1], "id STRING, moves STRING, name STRING")


def expected(games, openings, n):
    found = []
    for white, black, moves, result in games:
        first = " ".join((moves or "").split(" ")[:n])
        hits = sorted((len(m.split(" ")), i, m) for i, m, _ in openings if moves and starts(first, m))
        found += [(white, black, moves, result, i, m, int(k == len(hits) - 1)) for k, (_, i, m) in enumerate(hits)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("n", [10, 3])
@pytest.mark.parametrize("large", [False, True])
def test_match_prefixes(frames, data, n, large, monkeypatch):
    monkeypatch.setattr(matching, "small_on_disk", lambda df: not large)
    found = match_prefixes(*frames, n=n)
    assert rows(found) == expected(*data, n)


def test_real_games_count_matched_games(frames, data):
    matched = sum(1 for g in data[0] if g[2] and any(starts(g[2], m) for _, m, _ in data[1]))
    assert match_prefixes(*frames).agg(F.sum("real_game")).first()[0] == matched
    assert deepest_match(*frames).count() == matched


def test_whole_tokens_only(spark):
    games = spark.createDataFrame([("e7e8q x",)], "moves STRING")
    openings = spark.createDataFrame([("1", "e7e8")], "id STRING, moves STRING")
    assert match_prefixes(games, openings).count() == 0


def test_empty_dictionary(spark):
    games = spark.createDataFrame([("a b",)], "moves STRING")
    openings = spark.createDataFrame([], "id STRING, moves STRING")
    assert match_prefixes(games, openings).count() == 0


def test_match_by_name(spark):
    games = spark.createDataFrame(
        [("a b c", "Base: Line"), ("a b c", "Other"), ("z", "Base"), ("a b c", "Ba.e")], "moves STRING, original_name STRING"
    )
    openings = spark.createDataFrame(
        [("1", "a", "Base"), ("2", "a b", "Base: Deep"), ("3", "a b c", "Else")], "id STRING, moves STRING, name STRING"
    )
    found = match_by_name_and_prefix(games, openings)
    assert rows(found, "original_name", "matched_id") == [
        ("Ba.e", None), ("Base", None), ("Base: Line", "2"), ("Other", None),
    ]


def test_exact_lookup_takes_smallest_id(spark):
    openings = spark.createDataFrame([("2", "1. e4"), ("1", "1. e4")], "id STRING, pgn STRING")
    shown = spark.createDataFrame([("1. e4",), ("1. d4",)], "pgn STRING")
    assert rows(exact_sequence_lookup(shown, openings)) == [("1. d4", None), ("1. e4", "1")]


def above(openings, opening):
    """Ids above an opening and its own, from the nearest."""
    i, moves, _ = opening
    found = [(len(m.split(" ")), j) for j, m, _ in openings if (m != moves and starts(moves, m)) or (m == moves and j <= i)]
    return [j for _, j in sorted(found, reverse=True)]


def test_closure_and_edges(frames, data):
    paths = {o[0]: above(data[1], o) for o in data[1]}
    closure = sorted((i, a, k) for i, path in paths.items() for k, a in enumerate(path))
    assert rows(prefix_closure(frames[1])) == sorted(closure, key=repr)
    edges = [(i, path[1] if len(path) > 1 else None) for i, path in paths.items()]
    assert rows(prefix_edges(frames[1])) == sorted(edges, key=repr)


def test_above_is_a_comparison_of_intervals(frames, data):
    found = opening_intervals(frames[1]).collect()
    assert {r["id"]: r["depth"] for r in found} == {o[0]: len(above(data[1], o)) for o in data[1]}
    pairs = {(a["id"], b["id"]) for a in found for b in found if a["first"] <= b["first"] <= a["last"]}
    assert pairs == {(a, o[0]) for o in data[1] for a in above(data[1], o)}


def test_repeated_rows_and_memory_of_a_player(spark, frames, data):
    """Rows that repeat count each; no set of a player's openings stands beside the rows."""
    counts = spark.createDataFrame([("p", "a", *[1] * 6), ("p", "a", *[2] * 6), ("p", "a_again", *[4] * 6)], "id STRING, matched_id STRING, " + ", ".join(f"{c} INT" for c in SIX_COUNTS))
    assert rows(base_nodes(counts, frames[1])) == [("p", "a")]
    assert rows(rollup_counts(counts, frames[1]), "matched_id", "won_b") == [("a", 7), ("a_again", 4)]
    plan = rollup_counts(counts, frames[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_rollup_and_base(spark, frames, data):
    rng = random.Random(3)
    ids = [o[0] for o in data[1]]
    paths = {o[0]: above(data[1], o) for o in data[1]}
    table = [(f"p{p}", i, *[rng.randrange(5) + 1 for _ in SIX_COUNTS]) for p in range(8) for i in rng.sample(ids, 7)]
    counts = spark.createDataFrame(table, "id STRING, matched_id STRING, " + ", ".join(f"{c} INT" for c in SIX_COUNTS))
    openings = frames[1]

    summed, base = {}, []
    for player in {t[0] for t in table}:
        own = {t[1]: t[2:] for t in table if t[0] == player}
        base += [(player, i) for i in own if not any(a in own for a in paths[i][1:])]
        for node in ids:
            if any(a in own for a in paths[node]):
                under = [own[i] for i in own if node in paths[i]]
                if under:
                    summed[player, node] = tuple(map(sum, zip(*under)))
    assert rows(base_nodes(counts, openings)) == sorted(base, key=repr)
    assert rows(rollup_counts(counts, openings)) == sorted(((*k, *v) for k, v in summed.items()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_small_dictionary_keeps_games_in_place(spark, tmp_path, frames):
    """Games are neither shuffled nor compared pairwise with the dictionary."""
    for name, frame in zip(("games", "openings"), frames):
        frame.write.parquet(str(tmp_path / name))
    text = plan(match_prefixes(*(spark.read.parquet(str(tmp_path / name)) for name in ("games", "openings"))))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    games_side = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "moves" in line and "white" in line]
    assert not games_side


def test_plan_of_large_dictionary(frames):
    entries = frames[1].select(F.col("moves").alias("key"), "id", "name", token_count(F.col("moves")).alias("tokens"))
    text = plan(matching.chain_by_shuffle(frames[0], entries, "moves", 10))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_small_dictionary_from_large_files_keeps_games_in_place(spark, tmp_path, frames, monkeypatch):
    """The distinct openings' own size counts, not that of files which repeat them."""
    from seqstats import session

    games, openings = frames
    games.write.parquet(str(tmp_path / "games"))
    repeated = openings.crossJoin(spark.range(3000).toDF("_n")).repartition(8)
    repeated.write.option("compression", "none").parquet(str(tmp_path / "openings"))
    games, many = (spark.read.parquet(str(tmp_path / name)) for name in ("games", "openings"))
    limit = 32 * 1024
    monkeypatch.setattr(matching, "small_on_disk", lambda df: session.small_on_disk(df, limit))
    assert not matching.small_on_disk(many)
    found = match_prefixes(games, many.drop("_n").distinct())
    text = plan(found)
    assert not [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "moves" in line and "white" in line]
    assert rows(found) == rows(match_prefixes(frames[0], openings.distinct()))
