from datetime import date

import pytest
from conftest import rows

from seqstats import session
from seqstats.catalog.fixture import Inputs
from seqstats.catalog.queries import QUERIES
from seqstats.operators import ks, significance
from seqstats.operators.shaping import (
    first_n,
    flatten_profile,
    sort_by_deviation,
    sort_by_player,
    sort_by_sequence,
    union_all,
)
from seqstats.sources.stages import (
    checkpointed,
    month_range,
    promote,
    read_known,
    read_month_stages,
    read_months,
    stage_name,
    write_csv,
    write_months,
    write_stage,
)


def test_month_range():
    assert month_range("2022-11", "2023-02") == ["2022-11", "2022-12", "2023-01", "2023-02"]
    this = date.today().strftime("%Y-%m")
    assert month_range(this) == [this]
    with pytest.raises(ValueError):
        month_range("2023-02", "2023-01")


def test_stage_name_changes_the_stem_only():
    assert stage_name("my.p/2022-07.parquet", "prob") == "my.p/2022-07_prob.parquet"
    assert stage_name("2022-07") == "2022-07.parquet"


def test_months_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2022-{i % 12 + 1:02d}") for i in range(48)], "v INT, month STRING")
    write_months(df, str(tmp_path / "t"))
    found = read_months(spark, str(tmp_path / "t"), "2022-03", "2022-04")
    wanted = [(f"2022-{i % 12 + 1:02d}", i) for i in range(48) if i % 12 in (2, 3)]
    assert rows(found, "month", "v") == sorted(wanted, key=repr)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text


def test_month_stages(spark, tmp_path):
    for month in ("2022-01", "2022-02", "2022-03"):
        write_stage(spark.createDataFrame([(month,)], "m STRING"), str(tmp_path), "players", month)
    assert rows(read_month_stages(spark, str(tmp_path), "players", "2022-02", "2022-03")) == [("2022-02",), ("2022-03",)]


def test_known_table_may_be_missing(spark, tmp_path):
    path = str(tmp_path / "known")
    assert read_known(spark, path, "id", "id STRING, country STRING").count() == 0
    spark.createDataFrame([("a", "DE"), ("a", "DE")], "id STRING, country STRING").write.parquet(path)
    assert rows(read_known(spark, path, "id", "id STRING")) == [("a", "DE")]


def test_batches_are_repeatable_and_promoted(spark, tmp_path):
    path = str(tmp_path / "known")
    profile = "id STRING, profile STRUCT<country: STRING, bio: STRING>"
    first = flatten_profile(spark.createDataFrame([("Ann", ("DE", "hi"))], profile))
    for _ in range(2):
        checkpointed(first, path, 0)
    checkpointed(spark.createDataFrame([("bob", "FR")], "id STRING, country STRING"), path, 1)
    spark.createDataFrame([("old", "IT")], "id STRING, country STRING").write.parquet(path)
    found = promote(spark, path, read_known(spark, path, "id", "id STRING, country STRING"))
    assert rows(found, "id", "country", "bio") == [("ann", "DE", "hi"), ("bob", "FR", None), ("old", "IT", None)]
    assert not session.path_exists(spark, f"{path}_temp")


def test_csv_keeps_quotes_and_order(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a", b'), (2, "plain")], "n INT, t STRING").orderBy("n")
    write_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert 'say ""a"", b' in text


def test_size_check_looks_at_files_only(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a b"))
    read = spark.read.parquet(str(tmp_path / "a b"))
    assert session.small_on_disk(read) and not session.small_on_disk(read, limit=100)
    assert session.small_on_disk(read.union(read).distinct()) and not session.small_on_disk(spark.range(10))


def test_known_rows_with_one_key(spark, tmp_path):
    """The first by the order, without an order the least; never parts of several rows."""
    path = str(tmp_path / "known")
    spark.createDataFrame([("a", "x", 9, 2), ("a", "y", 1, 1), ("b", "z", 5, 1), ("a", "x", 8, 3)], "id STRING, t STRING, n INT, seen INT").write.parquet(path)
    assert rows(read_known(spark, path, "id", "id STRING", "seen")) == [("a", "y", 1, 1), ("b", "z", 5, 1)]
    assert rows(read_known(spark, path, "id", "id STRING")) == [("a", "x", 8, 3), ("b", "z", 5, 1)]


def test_sorts_keep_their_order(spark):
    """What comparisons by hash do not see: the order of the sorted results."""
    openings = spark.createDataFrame([("2", "b"), ("1", "b"), ("3", "a")], "id STRING, uci STRING")
    assert [r["id"] for r in sort_by_sequence(openings).collect()] == ["3", "1", "2"]
    scored = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 2.0), ("w", "B", 2.0), ("v", "C", None)], "matched_id STRING, country STRING, dev_played DOUBLE")
    assert [tuple(r)[:2] for r in sort_by_deviation(scored).collect()] == [("w", "B"), ("x", "B"), ("x", "A"), ("v", "C")]
    players = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "id STRING, matched_id STRING")
    assert [tuple(r) for r in sort_by_player(players).collect()] == [("b", "2"), ("b", "1"), ("a", "1")]
    assert [r["id"] for r in first_n(players, 2, ["matched_id", "id"]).collect()] == ["a", "b"]


def test_union_all_checks_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x INT, y INT"), spark.createDataFrame([(3, 4, 5)], "y INT, x INT, z INT")
    assert rows(union_all([a, b])) == [(1, 2), (4, 3)] and union_all([a, b]).columns == ["x", "y"]
    with pytest.raises(ValueError, match="frame 2 lacks the columns y"):
        union_all([a, a.drop("y")])


def test_queries_are_built_without_jobs(spark):
    """Entries that write nothing start no job before their first action."""
    sinks = {
        "read_game_records", "header_columns", "move_tokens", "union_files", "read_openings", "read_stage", "read_months", "read_known",
        "write_stage", "write_stage_gzip", "write_csv", "checkpointed", "read_features", "write_features", "write_metadata",
        "read_metadata", "games", "merge_months", "month_ledger", "promote_resumed", "merge_profiles", "month_range", "request_batches", "new_player_batches",
        "new_players_by_filter",
    }
    tracker = spark.sparkContext.statusTracker()
    for name in set(QUERIES) - sinks:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not tracker.getJobIdsForGroup(f"build-{name}"), name
    spark.sparkContext.setJobGroup("tests", "tests")


def test_significant_rows_in_both_modes(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    tables = ks.ks_test(i.counted(), "asymp"), i.standardized(), i.player_counts(), i.moments(), i.openings()
    limits = {"alpha": 0.9, "min_dev": 0.1, "min_players": 1}
    both = significance.significant_in_either(*tables, **limits).persist()
    for mode in ("played", "won"):
        alone = significance.all_significant(*tables, mode, **limits)
        found = alone.collect()
        assert rows(both.where(mode).drop("played", "won")) == rows(alone) and found
        assert [r[f"dev_{mode}"] for r in found] == sorted((r[f"dev_{mode}"] for r in found), reverse=True)
    text = significance.colored_deviations(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in text and "Python" not in text


def test_a_promotion_that_stops_anywhere_ends_with_the_same_table(spark, tmp_path, monkeypatch):
    """Every step of the file system may be the last of a run; the next run ends with each batch in the table once."""
    from seqstats.sources import stages

    steps = ("rename_path", "move_path", "delete_path")

    def collect(path):
        schema = "id STRING, country STRING"
        promote(spark, path, read_known(spark, path, "id", schema))

    def begin(path):
        spark.createDataFrame([("old", "IT")], "id STRING, country STRING").write.parquet(path)
        for batch, row in enumerate([("ann", "DE"), ("bob", "FR")]):
            checkpointed(spark.createDataFrame([row], "id STRING, country STRING"), path, batch)

    calls = []
    for name in steps:
        def counted(*a, inner=getattr(stages, name), name=name):
            calls.append(name)
            return inner(*a)
        monkeypatch.setattr(stages, name, counted)
    begin(str(tmp_path / "whole"))
    collect(str(tmp_path / "whole"))
    monkeypatch.undo()
    wanted = [("ann", "DE"), ("bob", "FR"), ("old", "IT")]
    assert rows(spark.read.parquet(str(tmp_path / "whole"))) == wanted and len(calls) == 4
    for last in range(1, len(calls) + 1):
        path, done = str(tmp_path / str(last)), []
        begin(path)
        with monkeypatch.context() as patch:
            for name in steps:
                def stopping(*a, inner=getattr(stages, name)):
                    done.append(1)
                    if len(done) == last:
                        raise RuntimeError("stopped")
                    inner(*a)
                patch.setattr(stages, name, stopping)
            with pytest.raises(RuntimeError):
                collect(path)
        collect(path)
        assert rows(spark.read.parquet(path)) == wanted, last
        assert not any(session.path_exists(spark, f"{path}_{x}") for x in ("temp", "merged", "old"))


def test_a_stop_between_the_two_renames_of_a_move(spark, tmp_path):
    """The old table is out of the way and the new one not yet in place: committed, so the new one comes."""
    from seqstats.sources import stages

    path = str(tmp_path / "t")
    spark.createDataFrame([("old", "IT")], "id STRING, country STRING").write.parquet(path)
    checkpointed(spark.createDataFrame([("ann", "DE")], "id STRING, country STRING"), path, 0)
    stages.commit_batches(spark, path, spark.read.parquet(path))
    session.rename_path(spark, path, f"{path}_old")
    assert rows(read_known(spark, path, "id", "id STRING")) == [("ann", "DE"), ("old", "IT")]
    with pytest.raises(OSError):
        session.rename_path(spark, path, path)
