"""The whole pipeline over files, from game text to the enriched map."""

import json
import random

from conftest import rows
from pyspark.sql import functions as F

from seqstats.__main__ import main, parser
from seqstats.operators.counts import player_openings
from seqstats.plans import jobs
from seqstats.sources.features import read_features, read_metadata_openings
from seqstats.sources.openings import read_openings
from seqstats.sources.stages import read_stage, stage_path, write_stage

OPENINGS = {"A00": ("1. a3", "a2a3"), "B00": ("1. e4", "e2e4"), "C20": ("1. e4 e5", "e2e4 e7e5"), "C40": ("1. e4 e5 2. Nf3", "e2e4 e7e5 g1f3")}


def games_text(rng, n):
    starts = ["1. e4 e5 2. Nf3 Nc6", "1. e4 c5 2. Nf3 d6", "1. e4 e5 2. f4 exf4", "1. a3 a6", "1. h4 h5"]
    for _ in range(n):
        white, black = rng.sample(range(24), 2)
        result = rng.choice(["1-0", "0-1", "1/2-1/2"])
        yield (
            f'[Event "Rated"]\n[White "{rng.choice("Pp")}{white}"]\n[Black "P{black}"]\n[Result "{result}"]\n\n{rng.choice(starts)} {result}\n'
        )


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    root = str(tmp_path)
    folder = tmp_path / "openings"
    folder.mkdir()
    lines = ["eco\tname\tpgn\tuci"] + [f"{eco}\tName {eco}\t{pgn}\t{uci}" for eco, (pgn, uci) in OPENINGS.items()]
    (folder / "a.tsv").write_text("\n".join(lines) + "\n")
    openings = read_openings(spark, str(folder))

    for month in ("2022-01", "2022-02"):
        (tmp_path / f"{month}.pgn").write_text("\n".join(games_text(rng, 600)))
        jobs.run_games(spark, root, month, str(tmp_path / f"{month}.pgn"), openings)
        jobs.run_player_openings(spark, root, month, openings)
        by_path = read_stage(spark, root, "players", month)
        plain = player_openings(read_stage(spark, root, "games", month))
        assert rows(by_path.select(*plain.columns)) == rows(plain)
    name = "2022-01_2022-02"
    assert jobs.run_merge_months(spark, root, "2022-01", "2022-02") == stage_path(root, "players", name)
    merged = read_stage(spark, root, "players", name)
    games = read_stage(spark, root, "games", "2022-01").unionByName(read_stage(spark, root, "games", "2022-02"))
    assert merged.agg(F.sum("real_game_w")).first()[0] == games.agg(F.sum("real_game")).first()[0]
    assert merged.groupBy("id", "matched_id").count().where("count > 1").count() == 0

    batches = jobs.run_new_player_batches(spark, root, name)
    assert len(batches.first()["ids"].split(",")) == 24
    found = [(f"P{i}", ("DE" if i % 3 else "FR",)) for i in range(20)]
    jobs.run_merge_profiles(spark, root, spark.createDataFrame(found, "id STRING, profile STRUCT<country: STRING>"))
    assert len(jobs.run_new_player_batches(spark, root, name).first()["ids"].split(",")) == 4

    jobs.run_player_probabilities(spark, root, name)
    jobs.run_country_probabilities(spark, root, name, min_games=10)
    assert rows(read_stage(spark, root, "countries", name, "player_count")) == [("DE", 13), ("FR", 7)]
    jobs.run_distributions(spark, root, name, min_games=10)
    whole = read_stage(spark, root, "distributions", name, "global")
    assert whole.where("metric = 'p_w'").groupBy("matched_id").agg(F.sum("players")).select("sum(players)").distinct().collect() == [(24,)]
    jobs.run_ks_test(spark, root, name, min_games=10)
    assert read_stage(spark, root, "ks_test", name).count() == 8
    jobs.run_significant(spark, root, name, openings, alpha=1.1, min_dev=0.0, min_players=1)
    csv = spark.read.option("header", True).csv(stage_path(root, "significant", name, "played").replace(".parquet", ".csv"))
    assert csv.count() == 8 and csv.columns[:3] == ["matched_id", "country", "p_val_played"]

    iso = spark.createDataFrame([("DE", "Germany", "DEU"), ("FR", "France", "FRA")], jobs.KNOWN_COUNTRIES)
    jobs.run_known_countries(spark, root, name, iso)
    jobs.run_known_countries(spark, root, name, iso)
    assert rows(read_stage(spark, root, "countries", "known_countries"), "ISO_A2") == [("DE",), ("FR",)]
    shape = {"type": "Feature", "geometry": None}
    features = [shape | {"properties": {"ISO_A3": c}} for c in ("DEU", "FRA", "USA")]
    (tmp_path / "map.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    jobs.run_feature_enrichment(spark, root, name, openings, str(tmp_path / "map.geojson"), f"{root}/map")
    assert read_features(spark, f"{root}/map/countries.geojsonl", lines=True).count() == 3
    assert read_metadata_openings(spark, f"{root}/map/enrichment_metadata").count() == len(OPENINGS)
    for _ in range(2):
        jobs.run_feature_enrichment(spark, root, name, openings, str(tmp_path / "map.geojson"), f"{root}/map", document=True)
    text = "".join(p.read_text() for p in (tmp_path / "map/enrichment_metadata.json").glob("part-*"))
    metadata = json.loads(text)
    assert (metadata["positive_positions"], metadata["negative_positions"], metadata["num_countries"]) == (300, 100, 2)
    assert sorted(o["pgn"] for o in metadata["openings"].values()) == sorted(p for p, _ in OPENINGS.values())
    assert not [p.name for p in tmp_path.rglob("*") if p.name.endswith(("_next", "_old", "_next.parquet"))]
    opening = next(i for i, o in metadata["openings"].items() if o["pgn"] == "1. e4")
    points = jobs.run_opening_profile(spark, root, name, openings, opening)
    assert rows(points, "country", "color") == [("France", "w"), ("Germany", "w")]


def test_country_scores_stay_in_the_engine(spark, tmp_path):
    """No Python stage and no pairwise join between player rows and country scores."""
    root = str(tmp_path)
    columns = "id STRING, matched_id STRING, total_count_w BIGINT, total_count_b BIGINT, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE, country STRING"
    write_stage(spark.createDataFrame([("a", "x", 50, 50, 0.5, 0.5, 0.5, 0.5, "DE")], columns), root, "players", "t", "prob")
    players = read_stage(spark, root, "players", "t", "prob")
    for table in jobs.country_probabilities(players).values():
        text = table._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "NestedLoop" not in text
    counted = jobs.country_probabilities(players)["player_count"]._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(country)" in counted and "p_won_w" not in counted


def test_command_line_knows_every_job_and_parameter():
    line = parser()
    args = line.parse_args("--root r significant --name x --alpha 0.05 --min-dev 1 --min-players 7".split())
    assert (args.alpha, args.min_dev, args.min_players) == (0.05, 1.0, 7)
    args = line.parse_args("--root r ks --name x --method finite --exact-limit 5 --min-games 3".split())
    assert (args.method, args.exact_limit, args.min_games) == ("finite", 5, 3)
    for text in ("new-players --name x --out o", "merge-profiles --responses f", "opening-profile --name x --opening i --out o", "games --name x --pgn f --n 4"):
        assert line.parse_args(f"--root r {text}".split()).job == text.split()[0]


def test_command_line_runs_a_job(spark, tmp_path):
    columns = "id STRING, matched_id STRING, total_count_w BIGINT, total_count_b BIGINT, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE, country STRING"
    write_stage(spark.createDataFrame([("a", "x", 5, 5, 0.5, 0.5, 0.5, 0.5, "DE")], columns), str(tmp_path), "players", "t", "prob")
    main(["--root", str(tmp_path), "countries", "--name", "t", "--min-games", "10"])
    assert rows(read_stage(spark, str(tmp_path), "countries", "t", "player_count")) == [("DE", 1)]
