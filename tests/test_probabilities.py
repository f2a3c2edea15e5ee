import pytest
from conftest import rows
from pyspark.sql import functions as F

from seqstats.operators.distributions import distribution_arrays
from seqstats.functions.numbers import bin_counts, bin_position
from seqstats.operators.counts import COUNTS, dedupe_known, merge_counts, player_openings, upsert_latest
from seqstats.operators.filters import filter_min_games, filter_significant
from seqstats.operators.probabilities import (
    approx_player_counts,
    country_player_counts,
    global_moments,
    join_country,
    moment_states,
    moments_of,
    player_probabilities,
    player_sketches,
    standardize,
    united_sketches,
    unstandardize,
    updated_states,
)
from seqstats.operators.shaping import METRICS, union_all

GAME = "white STRING, black STRING, result STRING, matched_id STRING, real_game BIGINT"


def test_counts_for_both_sides(spark):
    games = spark.createDataFrame(
        [
            ("Ann", "Bob", "1-0", "x", 0),
            ("Ann", "Bob", "1-0", "y", 1),
            ("Bob", "Ann", "1/2-1/2", "x", 1),
            ("Ann", "Ann", "0-1", "x", 1),
            ("ANN", "Bob", "0-1", "x", 1),
            ("Ann", "Bob", "1-0", None, 1),
        ],
        GAME,
    )
    assert rows(player_openings(games), "id", "matched_id", *COUNTS) == sorted(
        [
            # names are lower-cased after grouping, so two spellings stay two rows
            ("ann", "x", 2, 1, 1, 2, 1, 0, 1, 2),
            ("ann", "x", 1, 0, 1, 0, 0, 0, 1, 0),
            ("ann", "y", 1, 1, 0, 0, 0, 0, 1, 0),
            ("bob", "x", 1, 0, 0, 2, 1, 1, 1, 1),
            ("bob", "y", 0, 0, 0, 1, 0, 1, 0, 1),
        ],
        key=repr,
    )
    merged = merge_counts([player_openings(games), player_openings(games)])
    assert rows(merged.where("id = 'ann' AND matched_id = 'x'"), "count_w", "real_game_b") == [(6, 4)]


def test_counts_of_dealt_months_are_written_where_they_are(spark, tmp_path):
    """The same rows as without parts, together by month after one shuffle of the games' rows."""
    from seqstats.sources.stages import write_months

    table = [
        (f"P{i % 7}" if i % 11 else None, f"p{i % 5}", ("1-0", "0-1", "1/2-1/2", None)[i % 4], "xyz"[i % 3] if i % 13 else None, i % 2,
         f"2022-0{i % 3 + 1}" if i % 17 else None)
        for i in range(300)
    ]
    path = str(tmp_path / "games")
    spark.createDataFrame(table, GAME + ", month STRING").write.parquet(path)
    games = spark.read.parquet(path)
    columns = ("month", "id", "matched_id", *COUNTS)
    dealt, plain = player_openings(games, ("month",), parts=3), player_openings(games, ("month",))
    assert rows(dealt, *columns) == rows(plain, *columns) and dealt.columns == plain.columns
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(month" in text
    write_months(dealt, str(tmp_path / "months"), dealt=True)
    written = spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in plain.dtypes)}").parquet(str(tmp_path / "months"))
    assert rows(written, *columns) == rows(plain, *columns)


def test_months_are_dealt_to_all_tasks(spark):
    from seqstats.sources.stages import month_parts

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for months in (1, 3, 80, 10_000):
        assert month_parts(spark, months) >= 8 and month_parts(spark, months) * months >= 8 * tasks


def test_sums_shuffle_each_row_once(spark):
    counts = player_openings(spark.createDataFrame([("Ann", "Bob", "1-0", "x", 1)], GAME))
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    text = merge_counts([counts, counts])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(id" in text


def test_counts_meet_many_profiles_without_another_shuffle(spark, tmp_path):
    """Profiles that are not broadcast are brought to the counts, which lie together by id after their one shuffle."""
    table = [("Ann", "Bob", "1-0", "x", 1), ("ANN", None, "0-1", "x", 1), ("Bob", "Eve", "1-0", "y", 0), ("Ann", "Bob", "1-0", None, 1)]
    path = str(tmp_path / "games")
    spark.createDataFrame(table, GAME).write.parquet(path)
    profiles = spark.createDataFrame([("ann", "DE"), ("bob", None), ("eve", "FR"), ("eve", "IT"), (None, "PL")], "id STRING, country STRING")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = join_country(player_openings(spark.read.parquet(path)), profiles)
        shares = player_probabilities(player_openings(spark.read.parquet(path)), profiles)
        for df in (found, shares):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(lower(username" in text
        assert rows(found, "id", "matched_id", "count_w", "count_b", "country") == sorted(
            [
                ("ann", "x", 1, 0, "DE"), ("ann", "x", 1, 0, "DE"), (None, "x", 0, 1, None), ("bob", "x", 0, 1, None),
                ("bob", "y", 1, 0, None), ("eve", "y", 0, 1, "FR"), ("eve", "y", 0, 1, "IT"),
            ],
            key=repr,
        )
        assert rows(shares.select("id", "matched_id", "country").distinct()) == sorted(
            [("ann", "x", "DE"), ("bob", "x", None), ("bob", "y", None), ("eve", "y", "FR"), ("eve", "y", "IT")], key=repr
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def counts_frame(spark, table):
    return spark.createDataFrame(table, "id STRING, matched_id STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTS))


def test_zero_totals_give_null(spark):
    counts = counts_frame(spark, [("a", "x", 4, 1, 2, 0, 0, 0, 3, 0), ("a", "y", 1, 1, 0, 0, 0, 0, 1, 0)])
    profiles = spark.createDataFrame([("a", None), ("b", "DE")], "id STRING, country STRING")
    found = player_probabilities(counts, profiles)
    assert rows(found, "matched_id", "total_count_w", "total_count_b", "p_w", "p_b", "p_won_w", "p_won_b", "country") == [
        ("x", 4, 0, 1.0, None, 0.25, None, None),
        ("y", 4, 0, 0.25, None, 1.0, None, None),
    ]


PLAYER = "id STRING, matched_id STRING, country STRING, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE"


def test_moments_of_one_player_and_of_none(spark):
    players = spark.createDataFrame([("a", "x", "DE", 0.2, None, 0.5, None)], PLAYER)
    moments = global_moments(players)
    assert rows(moments, "mean_p_w", "std_p_w", "mean_p_b", "std_p_b") == [(0.2, 0.0, 0.0, 0.0)]
    country = spark.createDataFrame([("DE", "x", 0.4, 0.0, 0.5, None)], "country STRING, matched_id STRING, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE")
    assert rows(standardize(country, moments), "stand_p_w", "stand_p_b", "stand_p_won_b") == [(0.2 / 1e-17, 0.0, None)]


def test_undoing_standard_scores(spark):
    players = spark.createDataFrame(
        [(f"p{i}", "x", "DE" if i % 2 else "FR", i / 10, i / 20, i / 30, i / 40) for i in range(9)], PLAYER
    )
    moments = global_moments(players)
    means = players.groupBy("country", "matched_id").agg(*[F.avg(c).alias(c) for c in players.columns[3:]])
    scored = standardize(means, moments).withColumnsRenamed({"stand_p_w": "dev_played", "stand_p_won_w": "dev_won"})
    back = unstandardize(scored.join(moments, "matched_id"), "w")
    for r in back.collect():
        assert r["prob_played"] == pytest.approx(r["p_w"]) and r["prob_won"] == pytest.approx(r["p_won_w"])
    assert rows(country_player_counts(players)) == [("DE", 4), ("FR", 5)]


def test_min_games_drops_unknown_totals(spark):
    df = spark.createDataFrame([(25, 25), (49, 0), (100, None)], "total_count_w BIGINT, total_count_b BIGINT")
    assert rows(filter_min_games(df)) == [(25, 25)]


def test_significance_bounds(spark):
    table = [(0.009, 0.51, 2000), (0.01, 0.6, 2000), (0.001, 0.5, 2000), (0.001, -0.6, 1999), (0.001, -0.6, 2000), (None, 9.0, 9999), (0.001, None, 9999)]
    df = spark.createDataFrame(table, "p_val_played DOUBLE, dev_played DOUBLE, num_players BIGINT")
    assert rows(filter_significant(df)) == [(0.001, -0.6, 2000), (0.009, 0.51, 2000)]
    with pytest.raises(ValueError):
        filter_significant(df, "drawn")


def test_positions(spark):
    inf = float("inf")
    table = [(-1.0, 1), (-5.0, 1), (0.0, 101), (0.005, 101), (0.015, 102), (3.0, 400), (2e16, 400), (-2e16, 1), (None, 0), (float("nan"), 0), (inf, 0), (-inf, 0)]
    df = spark.createDataFrame([(z,) for z, _ in table], "z DOUBLE")
    found = [r[0] for r in df.select(bin_position(F.col("z"))).collect()]
    by_rule = [
        0 if z is None or z != z or abs(z) == inf else min(400, max(round((z + 1.0) / 0.01) + 1, 1)) for z, _ in table
    ]
    assert found == by_rule
    assert [p for p, (_, wanted) in zip(found, table) if p != wanted] == []
    assert bin_counts() == (300, 100)


def test_unions_and_upserts(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "k STRING, v INT")
    b = spark.createDataFrame([(9, "k2", True), (8, "k3", True)], "v INT, k STRING, extra BOOLEAN")
    assert rows(union_all([a, b, a])) == sorted([("k1", 1), ("k2", 2), ("k2", 9), ("k3", 8), ("k1", 1), ("k2", 2)])
    with pytest.raises(Exception):
        union_all([b, a])
    assert rows(upsert_latest(a, b.drop("extra"), ["k"])) == [("k1", 1), ("k2", 9), ("k3", 8)]
    repeated = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, None)], "k STRING, o INT, v STRING")
    assert rows(dedupe_known(repeated, "k", "o")) == [("k", 1, "a"), ("l", 3, None)]


def test_sketches_hold_their_bounds_and_unite(spark):
    """Three standard errors around the estimate hold the exact number, also where months overlap."""
    players = spark.range(120_000).select(
        F.concat(F.lit("p"), F.col("id") % 50_000).alias("id"), (F.col("id") % 3).cast("string").alias("month"),
        F.when(F.col("id") % 5 == 0, "A").otherwise("B").alias("country"),
    )
    players = players.unionByName(spark.createDataFrame([(None, "0", "A"), (None, "0", "C")], "id STRING, month STRING, country STRING"))
    monthly = player_sketches(players, ("month", "country"))
    found = {r["country"]: r for r in approx_player_counts(united_sketches(monthly)).collect()}
    exact = {r["country"]: r["num_players"] for r in country_player_counts(players).collect()}
    assert exact == {"A": 10_000, "B": 40_000, "C": 0} and found.keys() == exact.keys()
    for country, n in exact.items():
        assert found[country]["at_least"] <= n <= found[country]["at_most"]
    united = {r["country"]: r["num_players"] for r in approx_player_counts(united_sketches(player_sketches(players, ("country", "month")))).collect()}
    assert united == {c: r["num_players"] for c, r in found.items()}


def test_states_follow_changes_of_players(spark):
    """States after any additions and removals give the moments of the rows that are left."""
    schema = "id INT, matched_id STRING, " + ", ".join(f"{m} DOUBLE" for m in METRICS)
    made = [(i, f"o{i % 4}", 1e6 + (i * 37 % 11) / 7, None if i % 3 else i / 9, float(i % 2), None) for i in range(200)]
    df = spark.createDataFrame(made, schema).persist()
    first, second, gone = df.where("id < 90"), df.where("id >= 90"), df.where("id % 2 = 0 OR matched_id = 'o3'")
    states = updated_states(moment_states(first), moment_states(second))
    states = updated_states(states, moment_states(gone), -1)
    found = {r["matched_id"]: r.asDict() for r in moments_of(states).collect()}
    wanted = {r["matched_id"]: r.asDict() for r in global_moments(df.where("NOT (id % 2 = 0 OR matched_id = 'o3')")).collect()}
    assert found.keys() == wanted.keys() == {"o1"}
    for opening, row in wanted.items():
        for name, value in row.items():
            assert found[opening][name] == (pytest.approx(value, rel=1e-6, abs=1e-6) if name != "matched_id" else value)
    with pytest.raises(ValueError):
        updated_states(states, states, 2)
    df.unpersist()


def test_counted_players_of_large_tables_are_read_not_counted_again(spark, monkeypatch):
    """A query with several uses of the counted players: the same rows, and no use goes back to the games."""
    from seqstats.catalog import fixture
    from seqstats.catalog.queries import QUERIES

    names = ("attach_player_counts", "join_moments", "unstandardize")
    lazy = {n: rows(QUERIES[n](spark, "/root/testdata/sf0.001")) for n in names}
    monkeypatch.setattr(fixture, "small_on_disk", lambda df: False)
    for name in names:
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not [f for f in found.inputFiles() if "lineitem" in f], name
        assert rows(found) == lazy[name] and lazy[name], name


def test_arrays_are_sorted_natively(spark):
    df = spark.createDataFrame([("p", "a", 0.5, None, float("nan"), 0.0), ("q", "a", 0.25, 0.5, 1.0, 0.5)], "id STRING, matched_id STRING, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE")
    found = distribution_arrays(df, ["matched_id"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert row["p_w_dist"] == [0.25, 0.5] and row["p_b_dist"] == [0.5]
    assert row["p_won_w_dist"][0] == 1.0 and row["p_won_w_dist"][1] != row["p_won_w_dist"][1]
