from pathlib import Path

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqstats.operators.membership import (
    MOST_BLOCKS,
    anti_join,
    blocks_for,
    key_filter,
    stored_filter,
    united_filters,
    with_perhaps,
)
from seqstats.operators.profiles import new_player_batches, new_players
from seqstats.plans import jobs
from seqstats.sources.stages import stage_path, write_stage


def named(spark, first, last):
    return spark.range(first, last, 1, 5).select(F.concat(F.lit("p"), "id").alias("id"))


def test_block_numbers():
    assert [blocks_for(k) for k in (0, 1, 16, 17, 33, 1_000)] == [1, 1, 1, 2, 4, 64]
    assert blocks_for(10**12) == MOST_BLOCKS


def test_every_known_key_passes_and_few_others(spark):
    known, blocks = named(spark, 0, 20_000), blocks_for(20_000)
    seen = key_filter(known, "id", blocks)
    assert with_perhaps(known, F.col("id"), seen, blocks).where("NOT perhaps").count() == 0
    assert with_perhaps(named(spark, 20_000, 60_000), F.col("id"), seen, blocks).where("perhaps").count() < 400  # 1 %


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "e", "", None])), st.lists(st.sampled_from(["a", "b", "", None])), st.sampled_from([1, 2, 64]))
def test_the_result_is_that_of_the_plain_join(spark, left, right, blocks):
    """Repeated rows and keys, nulls on both sides, empty tables, and a filter that lets nearly all through."""
    df = spark.createDataFrame([(x, i) for i, x in enumerate(left)], "id STRING, block INT")
    known = spark.createDataFrame([(x,) for x in right], "id STRING")
    found = anti_join(df, F.col("id"), known, "id", key_filter(known, "id", blocks), blocks)
    assert found.columns == ["id", "block"]
    keys = {x for x in right if x is not None}
    assert rows(found) == sorted(((x, i) for i, x in enumerate(left) if x not in keys), key=repr)


def test_filters_of_parts_are_united(spark):
    whole = key_filter(named(spark, 0, 3_000), "id", 64)
    parts = [key_filter(named(spark, a, a + 1_000), "id", 64) for a in (0, 1_000, 2_000)]
    assert rows(united_filters(parts)) == rows(whole)


def shuffled_rows(df):
    """Rows that each exchange of an executed plan has written."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        inner = [n for i in range(plan.children().size()) for n in walk(plan.children().apply(i))]
        if name == "ShuffleExchangeExec":
            return [plan.metrics().apply("shuffleRecordsWritten").value(), *inner]
        return inner

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_what_the_filter_lets_through_is_shuffled(spark, tmp_path):
    named(spark, 0, 5_000).write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    seen = stored_filter(known, "id", f"{tmp_path}/filters")
    ids = named(spark, 4_000, 40_000)
    let_through = with_perhaps(ids, F.col("id"), *seen).where("perhaps").count()
    assert 1_000 <= let_through < 1_400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = new_players(ids, known, seen)
        assert len(found.collect()) == 35_000
        assert sorted(shuffled_rows(found)) == sorted([let_through, 5_000])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stored_filter_belongs_to_one_state_of_the_table(spark, tmp_path):
    path, folder = f"{tmp_path}/known", f"{tmp_path}/filters"
    named(spark, 0, 10).write.parquet(path)
    first = stored_filter(spark.read.parquet(path), "id", folder)
    assert len(list((tmp_path / "filters").iterdir())) == 1
    stored_filter(spark.read.parquet(path), "id", folder)
    assert len(list((tmp_path / "filters").iterdir())) == 1
    assert rows(first[0]) == rows(key_filter(named(spark, 0, 10), "id", first[1]))
    named(spark, 10, 2_000).write.mode("append").parquet(path)
    seen = stored_filter(spark.read.parquet(path), "id", folder)
    assert seen[1] > first[1]
    assert with_perhaps(named(spark, 0, 2_000), F.col("id"), *seen).where("NOT perhaps").count() == 0


def test_an_empty_table_has_a_filter(spark, tmp_path):
    named(spark, 0, 0).write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    seen = stored_filter(known, "id", f"{tmp_path}/filters")
    assert new_players(named(spark, 0, 3), known, seen).count() == 3


def test_the_job_meets_large_tables_through_their_filter(spark, tmp_path, monkeypatch):
    root, name = str(tmp_path), "2022-07"
    write_stage(named(spark, 0, 300).select(F.upper("id").alias("id")), root, "players", name)
    write_stage(named(spark, 100, 200).withColumn("country", F.lit("DE")), root, "players", "known_players")
    plain = rows(jobs.run_new_player_batches(spark, root, name))
    monkeypatch.setattr(jobs, "small_on_disk", lambda df: False)
    assert rows(jobs.run_new_player_batches(spark, root, name)) == plain
    folder = jobs.filters_path(stage_path(root, "players", "known_players"))
    assert list(Path(folder).iterdir())
    profile = F.struct(F.lit("FR").alias("country"))
    jobs.run_merge_profiles(spark, root, named(spark, 0, 50).withColumn("profile", profile))
    left = jobs.run_new_player_batches(spark, root, name).selectExpr("explode(split(ids, ',')) AS id")
    assert rows(left) == sorted((f"P{i}",) for i in range(300) if i >= 200 or 50 <= i < 100)
    assert new_player_batches(named(spark, 0, 0), named(spark, 0, 5)).count() == 0
