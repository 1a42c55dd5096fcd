"""Small operators that are mostly used on their own."""

import json

import pytest
from pyspark.sql import functions as F

from skyquilt.operators import cluster, filters, merge, raster
from skyquilt.plans import chat, ingest, search, status
from skyquilt.sources import files


def test_feedback_and_keys(spark):
    targets = spark.createDataFrame([("tile", 1), ("tile", 1), ("change_result", 2)], "target_type string, target_id int")
    said = spark.createDataFrame([("tile", 1, "confirm"), ("tile", 3, "reject"), ("change_result", 1, "reject"), (None, None, "x")], "target_type string, target_id int, verdict string")
    good, rest = merge.accepted_feedback(said, targets)
    assert [r["verdict"] for r in good.collect()] == ["confirm"] and rest.count() == 3
    stored = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert sorted(r["id"] for r in merge.present(spark.createDataFrame([(1,), (5,)], "id int"), stored, ["id"]).collect()) == [1]


def test_masks_and_limits(spark):
    rows = spark.createDataFrame([(0.0, 4), (float("nan"), 4), (None, 4), (1.0, 4), (1.0, 9)], "v double, c int")
    assert [r[0] for r in rows.select(raster.mask_valid(F.col("v"), 0.0, F.col("c"))).collect()] == [False, False, False, True, False]
    assert rows.where(filters.at_least(F.col("v"), 0.5)).where("not isnan(v)").count() == 2 and rows.where(filters.at_least(F.col("v"), 0.0)).count() == 5
    filters.assert_inside([(1.0, 1.0)], (0, 0, 2, 2))
    with pytest.raises(ValueError):
        filters.assert_inside([(3.0, 1.0)], (0, 0, 2, 2))


def test_reports(spark, tmp_path):
    cache = spark.createDataFrame([("c/3/1/2.png", 1048576), ("c/3/1/3.png", 524288), ("c/10/1/3.png", 0), ("c/readme.txt", 9)], "path string, length long")
    assert sorted(tuple(r) for r in status.cache_stats(cache).collect()) == [(3, 2, 1.5), (10, 1, 0.0)]
    plans = spark.createDataFrame([("s2", "acquire"), ("s2", "gap"), ("s2", "acquire"), ("l8", "gap")], "source string, state string")
    assert {r["source"]: (r["windows"], r["found"], r["gaps"]) for r in ingest.acquisition_report(plans).collect()} == {"s2": (3, 2, 1), "l8": (1, 0, 1)}
    assert [r["line"] for r in status.report(spark.createDataFrame([("water", 0.256)], "change_type string, confidence double")).collect()] == ["- **water** confidence 0.26"]
    evidence = spark.createDataFrame([("tile", 1, "ndvi", 0.1), ("tile", 1, "ndvi", 0.2), ("tile", 1, "ndwi", 0.2)], "type string, id int, field string, value double")
    assert chat.cited(evidence).count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": " Big River "}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}))
    assert files.geojson_features(spark, str(tmp_path / "f.json")).collect()[0]["name"] == "big river"


def test_orders(spark):
    clusters = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    assert [r["label"] for r in cluster.reference_first(clusters, "label", 2).collect()] == [2, 0, 1]
    shown, found = spark.createDataFrame([(1, "a")], "tile_id int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "tile_id int, x string")
    rows = search.with_discovered(shown, found).collect()
    assert sorted((r["_group"], r["tile_id"]) for r in rows if "_group" in r.asDict()) in ([(0, 2), (1, 1)], [])
    assert {r["tile_id"] for r in rows} == {1, 2}
