import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seqstats.operators import geo
from seqstats.operators.profiles import new_player_batches, request_batches
from seqstats.sources.features import (
    read_collection,
    read_features,
    read_members,
    read_metadata,
    read_metadata_openings,
    write_features,
    write_metadata,
)

KNOWN = "ISO_A2 STRING, country STRING, ISO_A3 STRING"


def test_batches(spark):
    players = spark.createDataFrame([(i,) for i in ["b", "a", "c", "?", None, "Known", "a", "d", "e"]], "id STRING")
    known = spark.createDataFrame([("known",)], "id STRING")
    found = new_player_batches(players, known, size=2, per_period=2, period=60)
    assert rows(found) == [(0, 0, 0, 0, "a,b"), (0, 1, 0, 0, "c,d"), (0, 2, 1, 60, "e")]


def test_every_id_is_scheduled_beyond_the_quota(spark):
    ids = spark.range(0, 1_000, 1, 7).select(F.concat(F.when(F.col("id") % 2 == 0, "P").otherwise("p"), "id").alias("id"))
    ids = ids.unionByName(spark.createDataFrame([(None,)], "id STRING"))
    found = request_batches(ids, size=30, per_period=2, period=60, max_ids=400).orderBy("run", "batch_no").collect()
    order = [i for r in found for i in r["ids"].split(",")]
    assert order == sorted(f"{'Pp'[i % 2]}{i}" for i in range(1_000))
    assert [sum(len(r["ids"].split(",")) for r in found if r["run"] == k) for k in range(3)] == [400, 400, 200]
    assert all(len(r["ids"].split(",")) <= 30 and r["start_offset_s"] == r["batch_no"] // 2 * 60 for r in found)
    assert [r["batch_no"] for r in found if r["run"] == 2] == list(range(7))
    assert request_batches(ids.limit(0)).count() == 0


def test_first_run_has_no_known_players(spark):
    players = spark.createDataFrame([("a",)], "id STRING")
    nobody = spark.createDataFrame([], "id STRING, country STRING")
    assert rows(new_player_batches(players, nobody), "ids") == [("a",)]


def test_known_countries_grow(spark):
    iso = spark.createDataFrame([("DE", "Germany", "DEU"), ("FR", "France", "FRA"), ("IT", "Italy", "ITA")], KNOWN)
    known = spark.createDataFrame([("DE", "Germany", "DEU", "17")], KNOWN + ", place_id STRING")
    seen = spark.createDataFrame([("DE",), ("FR",), ("FR",), ("GB-ENG",)], "country STRING")
    found = geo.known_countries(seen, iso, known)
    assert rows(found, "ISO_A2", "country", "place_id") == [("DE", "Germany", "17"), ("FR", "France", None)]


@pytest.fixture()
def collection(tmp_path):
    features = [
        {"type": "Feature", "id": f"f{name}", "bbox": [0, 1, 2, 3], "properties": {"ISO_A3": code, "ADMIN": name, "area": 1.5, "UN": True, "PLAYER_COUNT": 99},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2.5, 3]]]}}
        for code, name in (("DEU", "Germany"), ("FRA", "France"), ("-99", "Nowhere"), ("-99", "Elsewhere"))
    ]
    path = tmp_path / "countries.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "countries", "crs": {"n": 1}, "features": features}, indent=1))
    return str(path)


def test_enrichment(spark, collection, tmp_path):
    scores = ", ".join(f"{p}_{s} DOUBLE" for p in ("p", "stand_p") for s in ("w", "b", "won_w", "won_b"))
    country = spark.createDataFrame(
        [
            ("DE", "A00-1-2", 0.25, 0.5, 0.125, None, 0.005, 9.0, -7.0, None),
            ("XX", "B00-1-2", 0.25, 0.5, 0.125, None, 0.0, 9.0, -7.0, None),
            ("FX", "B00-3-4", 0.75, 0.5, 0.125, 0.5, 0.0, 9.0, -7.0, 0.0),
            ("FR", "B00-3-4", 0.25, 0.5, 0.125, 0.5, 0.0, 9.0, -7.0, 0.0),
        ],
        "country STRING, matched_id STRING, " + scores,
    )
    counts = spark.createDataFrame([("DE", 12), ("XX", 5), ("FR", 7)], "country STRING, num_players BIGINT")
    known = spark.createDataFrame([("DE", "Germany", "DEU"), ("FR", "France", "FRA"), ("FX", "France", "FRA")], KNOWN)
    enriched = geo.feature_enrichment(country, counts, known, read_features(spark, collection))
    out = str(tmp_path / "out")
    write_features(enriched, out, document=True, collection=read_collection(spark, collection))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    document = json.loads(text)
    assert document["type"] == "FeatureCollection" and len(document["features"]) == 4
    assert document["name"] == "countries" and document["crs"] == {"n": 1}
    assert all(f["id"] == f"f{f['properties']['ADMIN']}" and f["bbox"] == [0, 1, 2, 3] for f in document["features"])
    write_features(enriched, f"{out}l")
    lines = [json.loads(x) for p in (tmp_path / "outl").glob("part-*") for x in p.read_text().splitlines()]
    key = lambda f: f["id"]
    assert sorted(lines, key=key) == sorted(document["features"], key=key)
    assert read_features(spark, f"{out}l", lines=True).where("size(members) = 2").count() == 4
    by_name = {f["properties"]["ADMIN"]: f["properties"] for f in document["features"]}
    germany, france, nowhere = (by_name[n] for n in ("Germany", "France", "Nowhere"))
    assert (germany["area"], germany["UN"], germany["PLAYER_COUNT"]) == (1.5, True, 12)
    assert (germany["A00-1-2_POS_W"], germany["A00-1-2_W"]) == (101, 0.25)
    assert (germany["A00-1-2_POS_B"], germany["A00-1-2_POS_WON_W"]) == (400, 1)
    assert (germany["A00-1-2_POS_WON_B"], germany["A00-1-2_WON_B"]) == (0, 0)
    assert (germany["B00-3-4_POS_W"], germany["B00-3-4_W"]) == (0, 0)
    assert france["B00-3-4_W"] == 0.75  # of two codes for one feature the greater counts
    assert nowhere["PLAYER_COUNT"] == 0 and nowhere["A00-1-2_W"] == 0
    assert not any(k.startswith("B00-1-2") for k in germany)  # its only country is unknown
    assert len(germany) == 5 + 2 * 8
    again = geo.feature_enrichment(country, counts, known, read_features(spark, out))
    assert again.select(F.size("properties")).distinct().count() == 1
    assert again.select(F.size("properties")).first()[0] == 5 + 2 * 8
    assert document["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [[[0, 1], [2.5, 3]]]}


@pytest.mark.parametrize("document", [False, True])
def test_metadata_is_updated_in_place(spark, tmp_path, document):
    path = str(tmp_path / "meta")
    moments = {f"{m}_{p}": 0.5 for p in ("p_w", "p_b", "p_won_w", "p_won_b") for m in ("mean", "std")}
    openings = spark.createDataFrame([{"matched_id": "A", "name": "N", "pgn": "1. a3", **moments}])
    earlier = spark.sql("SELECT map('note', parse_json('[1]'), 'num_countries', parse_json('7'), 'openings', parse_json('{}')) AS members")
    write_metadata(openings, spark.sql("SELECT 3"), (300, 100), path, document, earlier)
    found = read_metadata(spark, path, document).first()
    assert (found["positive_positions"], found["negative_positions"], found["num_countries"]) == (300, 100, 3)
    assert list(found["members"]) == ["note"]
    assert rows(read_metadata_openings(spark, path, document), "matched_id", "name", "mean_p_w") == [("A", "N", 0.5)]
    write_metadata(openings, spark.sql("SELECT 4"), (300, 100), f"{path}2", document, read_members(spark, path, document))
    assert read_metadata(spark, f"{path}2", document).select("num_countries", F.to_json("members")).first() == (4, '{"note":[1]}')


def test_grid_without_pairwise_join(spark):
    features = spark.createDataFrame([("DEU",), ("FRA",)], "ISO_A3 STRING")
    openings = spark.range(200).select(F.col("id").cast("string").alias("matched_id"))
    columns = "country STRING, iso_a2 STRING, matched_id STRING, " + ", ".join(
        f"pos_{s} INT, p_{s} DOUBLE" for s in ("w", "b", "won_w", "won_b")
    )
    grid = geo.dense_grid(features, openings, spark.createDataFrame([("DEU", "DE", "7", 1, 0.5, *[2, 0.25] * 3)], columns))
    assert grid.count() == 400 and grid.distinct().count() == 400
    assert rows(grid.where("p_w > 0"), "ISO_A3", "matched_id", "pos_w", "p_won_b") == [("DEU", "7", 1, 0.25)]
    text = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
