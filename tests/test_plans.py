import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyquilt import catalog, views
from skyquilt.operators import cluster, raster, series
from skyquilt.plans import change, chat, discovery, search, status
from skyquilt.sources import catalogs, files
from skyquilt.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert len(__spark_entry__.entry(spark).collect()) > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_with_everything(spark):
    request = search.Request(vector=catalog.QUERY, text="new construction", top_k=5, polygon=[(87.0, 21.0), (89.0, 21.0), (89.0, 24.0), (87.0, 24.0)], max_cloud=0.9, place=(88.0, 21.5), least_similarity=-1.0)
    rows = search.search(request, views.vectors(spark, SF), views.scenes(spark, SF), views.feedback(spark, SF), views.results(spark, SF)).collect()
    assert len(rows) <= 5 and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_discovery(spark):
    clusters, top = discovery.discover(views.vectors(spark, SF).limit(60), lon=88.0, lat=21.5, most=4, top_k=3)
    assert clusters.count() <= 4 and top.groupBy("label").count().where("count > 3").count() == 0


def test_dense_strategies(spark):
    rows = [(1, dt.datetime(2026, 1, 1) + dt.timedelta(days=i), i, 0.9 if i > 3 else 0.05, 0.9, 0.1, 0.9) for i in range(7)] + [(2, dt.datetime(2026, 1, 1 + i), i, 0.1, 0.9, 0.1, 0.9) for i in range(2)] + [(3, dt.datetime(2026, 1, 1), 0, 0.1, 0.9, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "area_id int, ts timestamp_ntz, tile_id int, score double, quality double, cloud double, valid_share double")
    got = {r["area_id"]: (r["strategy"], r["status"]) for r in change.dense(df).collect()}
    assert got == {1: ("dense", "confirmed"), 2: ("bitemporal", None), 3: ("listing", None)}


def test_regions_of_a_block(spark):
    rows = [(1, r, c, 1.0 if 5 <= r < 15 and 5 <= c < 15 else 0.0) for r in range(20) for c in range(20)]
    mask = spark.createDataFrame(rows, "tile_id int, row int, col int, value double")
    lit = dict(d_ndvi=-0.65, d_ndwi=0.0, d_ndbi=0.8, before_ndbi=-0.4, after_ndbi=0.4, after_ndwi=0.0, after_ndvi=0.1)
    deltas = mask.select("tile_id", "row", "col", *[F.lit(v).alias(k) for k, v in lit.items()])
    r = change.regions(deltas, mask).collect()
    assert len(r) == 1 and r[0]["area"] == 100 and r[0]["change_type"] == "construction"


def image(tile, built, seed=0, side=64, shift=0):
    """Pixels of a textured field with a built block in one corner, or in the other if `built`."""
    import numpy as np

    rng = np.random.default_rng(7)
    texture = rng.random((side, side)) * 0.2
    rows = []
    for r in range(side):
        for c in range(side):
            inside = min(r, c) >= side - 16 if built else max(r, c) < 16
            t = float(texture[(r - shift) % side, c])
            bands = {"blue": 0.1, "green": 0.15, "red": 0.35, "nir": 0.2, "swir1": 0.4} if inside else {"blue": 0.1, "green": 0.2, "red": 0.1, "nir": 0.6, "swir1": 0.2}
            rows += [(tile, r, c, b, min(1.0, v + t)) for b, v in bands.items()]
    return rows


def test_bitemporal_finds_a_built_block(spark):
    ddl = "tile_id long, row int, col int, band string, value double"
    pixels = spark.createDataFrame(image(1, False) + image(2, True) + image(3, False, shift=3), ddl)
    tiles = spark.createDataFrame([(i, dt.datetime(2024, i, 1), 0.9) for i in (1, 2, 3)], "tile_id long, ts timestamp_ntz, quality double")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3)], "area_id long, before_tile_id long, after_tile_id long")
    rows, regions = change.bitemporal(pairs, pixels, tiles, map_threshold=0.05)
    got = {r["area_id"]: r for r in rows.collect()}
    assert got[10]["change_score"] > got[11]["change_score"] and got[10]["area_ha"] > got[11]["area_ha"]
    # the map back to the before image
    assert abs(got[11]["dy"] + 3) < 0.5 and abs(got[11]["dx"]) < 0.5 and got[11]["correlation"] > 0.9 and got[11]["compared"] > 0.9
    # built in one corner, and green again in the other
    assert sorted(r["change_type"] for r in regions.where("area_id = 10").collect()) == ["clearance", "construction"]
    status = {c["item"]: c["status"] for c in got[11]["checks"]}
    assert status["registration"] == "pass" and status["clouds"] == "pass" and status["persistence"] == "info"


def test_earliest_change_of_a_stack(spark):
    ddl = "tile_id long, row int, col int, band string, value double"
    pixels = spark.createDataFrame([p for i in range(1, 7) for p in image(i, i >= 4)], ddl)
    tiles = spark.createDataFrame([(i, 10, dt.datetime(2024, i, 1), 0.9) for i in range(1, 7)], "tile_id long, area_id long, ts timestamp_ntz, quality double")
    pairs = spark.createDataFrame([(10, 1, 6)], "area_id long, before_tile_id long, after_tile_id long")
    seen = {r["tile_id"]: r["distance"] for r in change.observation_distances(pairs, tiles, pixels).collect()}
    # the first pass is what the others are dated from
    assert set(seen) == {2, 3, 4, 5, 6} and max(seen[2], seen[3]) < min(seen[4], seen[5], seen[6])
    threshold = (max(seen[2], seen[3]) + min(seen[4], seen[5], seen[6])) / 2
    row = change.bitemporal(pairs, pixels, tiles, tiles, prob_threshold=threshold)[0].collect()[0]
    assert row["earliest"] == dt.datetime(2024, 4, 1) and row["compared"] == 1.0
    none = change.bitemporal(pairs, pixels, tiles, tiles, prob_threshold=0.99)[0].collect()[0]
    assert none["earliest"] == dt.datetime(2024, 6, 1)


def test_few_pixels_in_common_give_no_score(spark):
    ddl = "tile_id long, row int, col int, band string, value double"
    other = [(2, r, c, b, v) for _, r, c, b, v in image(2, True) if r >= 60]
    pixels = spark.createDataFrame(image(1, False) + other, ddl)
    tiles = spark.createDataFrame([(i, dt.datetime(2024, i, 1), 0.9) for i in (1, 2)], "tile_id long, ts timestamp_ntz, quality double")
    row = change.bitemporal(spark.createDataFrame([(10, 1, 2)], "area_id long, before_tile_id long, after_tile_id long"), pixels, tiles)[0].collect()[0]
    assert row["compared"] < 0.1 and row["change_score"] is None


def test_histogram_match_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    side = lambda: [(p, "b", float(v)) for p in (1, 2) for v in rng.integers(0, 40, 300) * rng.integers(1, 6) / 255]
    a, b = side(), side()
    got = {(r["p"], r["value"]): r["matched"] for r in raster.histogram_match(spark.createDataFrame(a, "p int, band string, value double"), spark.createDataFrame(b, "p int, band string, value double"), ("p",)).collect()}
    for p in (1, 2):
        x, y = (np.sort(np.rint([v * 255 for q, _, v in rows if q == p])).astype(int) for rows in (a, b))
        cdf = lambda z, v: np.searchsorted(z, v, side="right") / len(z)
        spine = np.array([cdf(y, v) for v in range(256)])
        want = {v: int(np.abs(spine - cdf(x, v)).argmin()) for v in set(x.tolist())}
        assert {v: m for (q, v), m in got.items() if q == p} == want


def test_dense_analysis_of_stacks(spark):
    ddl = "tile_id long, row int, col int, band string, value double"
    passes = [(1, i, i >= 5) for i in range(8)] + [(2, i, False) for i in range(2)]
    pixels = spark.createDataFrame([x for area, i, built in passes for x in image(area * 100 + i, built, side=48)], ddl)
    stack = spark.createDataFrame([(area, area * 100 + i, dt.datetime(2024, 1, 1 + i), "optical", 0.9, 0.0, 1.0) for area, i, _ in passes], "area_id long, tile_id long, ts timestamp_ntz, mode string, quality double, cloud double, valid_share double")
    rows, fallback = change.analyse(stack, pixels, threshold=0.01)
    got = {r["area_id"]: r for r in rows.collect()}
    assert got[1]["strategy"] == "dense" and got[1]["status"] == "confirmed" and got[1]["onset"] == dt.datetime(2024, 1, 6)
    assert got[2]["strategy"] == "bitemporal" and [r["area_id"] for r in fallback.collect()] == [2]


def test_average_linkage_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8))
    v = np.concatenate([c + 0.3 * rng.normal(size=(12, 8)) for c in centres])
    rows = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "id int, v array<double>")
    got = {r["id"]: r["label"] for r in cluster.average_linkage(rows, "id", "v", 6).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(len(u))]
    while len(groups) > 6:
        far = lambda a, b: float(np.mean(1 - u[a] @ u[b].T))
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    want = {i: label for label, g in enumerate(sorted(groups, key=min)) for i in g}
    assert got == want


def test_following_reaches_over_ranges(spark):
    got = {r["id"]: r["n"] for r in series.following(spark.range(0, 500, 3), "id", "n").collect()}
    assert got == {i: (i + 3 if i < 498 else None) for i in range(0, 500, 3)}


def test_chat(spark):
    make = spark.createDataFrame
    messages = make([(1, "Search for the tile near 5", 5, None, ("ponds", [(12345678901, 0.5)])), (2, "hello", None, None, None), (3, "review of this change", None, 7, None), (4, "find fields", None, None, ("fields", []))], "m int, text string, tile_id long, change_id long, search struct<query:string,matches:array<struct<tile_id:long,score:double>>>")
    results = make([(7, 5, 6, 0.5, 12345.0, ["a", "b", "c"], 0.9, dt.datetime(2024, 1, 1))], "change_id long, before_tile_id long, after_tile_id long, confidence double, change_area_m2 double, reasons array<string>, quality_score double, created_at timestamp_ntz")
    tiles = make([(i, 1, dt.datetime(2024, 1, i), 88.0, 22.0, "MSI", 0.1 * (i - 5) * 3, 0.9, 0.5, 0.0, -0.2) for i in (5, 6)], "tile_id long, scene_id int, ts timestamp_ntz, lon double, lat double, sensor string, cloud double, quality double, ndvi double, ndwi double, ndbi double")
    said = make([(1, 7, "confirm", dt.datetime(2024, 1, 2), "Ann", "sure")], "feedback_id int, target_id long, verdict string, created_at timestamp_ntz, analyst string, note string")
    rows = chat.summary(chat.gathered(messages, results, tiles, make([(1,)], "scene_id int"), said, tiles))
    got = {r["m"]: r["summary"] for r in rows.collect()}
    assert got[2] == chat.NOTHING and got[4] == "No catalog matches found for 'fields'."
    assert got[1].startswith("Tile 5 was acquired on 2024-01-05 by MSI at 10.0m GSD. Quality score: 90.0%, cloud cover: 0.0%. Spectral indices: NDVI 0.5 (Dense Healthy Vegetation), NDWI 0.0 (Moist Soil / Wetland), NDBI -0.2 (Non-Urban).")
    assert got[1].endswith("Search for 'ponds' returned 1 matching tiles. Top matches: 12345678 (0.5).")
    assert got[3] == "The detected change has a 50.0% confidence score with an estimated footprint of 12,345 m². Baseline observation: 2024-01-05 vs Target observation: 2024-01-06. False alarm risk is MEDIUM (Cloud Shadow Risk: HIGH). Factors: a; b. Analyst audit trail: latest verdict is CONFIRM by Ann. Note: 'sure'"


def test_exports_refuse_missing_coordinates(spark):
    bad = spark.createDataFrame([(1, 88.0, None)], "tile_id int, lon double, lat double")
    with pytest.raises(Exception, match="coordinates are unavailable"):
        status.geojson(bad).collect()


def test_provenance(spark, tmp_path):
    good = {"source_portal": files.PORTALS[0], "underlying_dataset": files.DATASETS[0], "satellite": "s", "sensor": "MSI", "acquisition_date": "2024-01-01", "resolution_m": 10.0, "bounding_box": [88, 22, 89, 23], "license": "l", "download_date": "2024-01-02", "ps_named_source": "p", "cloud_cover_pct": 1.0}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"source_portal": "x", "resolution_m": -1.0}))
    errors = sorted(len(r["errors"]) for r in files.read_provenance(spark, str(tmp_path)).collect())
    assert errors == [0, 2]


def test_names_and_bands(spark):
    sensor, day = files.name_parts(F.lit("Sentinel-2_20240105_demo.tif"))
    r = spark.range(1).select(sensor.alias("s"), day.alias("d"), files.band_map(F.lit(None).cast("string"), F.lit("x"), F.lit(3)).alias("b")).collect()[0]
    assert r["s"] == "Sentinel-2" and r["d"] == dt.datetime(2024, 1, 5) and r["b"] == {"red": 1, "green": 2, "blue": 3}
    none, tags = F.lit(None).cast("string"), F.create_map(F.lit("PLATFORM"), F.lit("Landsat-8"), F.lit("DATETIME"), F.lit("2024:02:03 04:05:06"))
    named = F.array(*[F.lit(x) for x in ("Band blue", "Green", "B4 RED", "nir")])
    sensor, day = files.name_parts(F.lit("x_20240105.tif"), tags)
    r = spark.range(1).select(sensor.alias("s"), day.alias("d"), files.band_map(none, F.lit("landsat"), F.lit(6), named).alias("b"), files.name_parts(F.lit("a_99999999_20240105.tif"))[1].alias("e")).collect()[0]
    assert r["s"] == "Landsat-8" and r["d"] == dt.datetime(2024, 2, 3, 4, 5, 6) and r["b"] == {"blue": 1, "green": 2, "red": 3, "nir": 4} and r["e"] == dt.datetime(2024, 1, 5)
    assert files.synthetic_scene(spark, 16, 2).count() == 512


def test_catalogs(spark, tmp_path):
    lines = [{"id": "a", "properties": {"datetime": "2024-01-05T00:00:00Z", "eo:cloud_cover": 3.0}, "bbox": [88, 22, 89, 23]}, {"Id": "b", "ContentDate": {"Start": "2024-01-06T00:00:00Z"}, "CloudCover": 50, "bbox": [88, 22, 89, 23], "Online": False}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)))
    rows = catalogs.read_catalog(spark, str(tmp_path / "c.json"), "x")
    assert {r["product_id"]: r["online"] for r in rows.collect()} == {"a": True, "b": False}
    assert [r["product_id"] for r in catalogs.found(rows, (88.5, 22.5, 90, 24), "2024-01-01", "2024-02-01", 10).collect()] == ["a"]
    catalogs.register(spark)
    assert spark.read.format("offline_catalog").load().count() == 0


def test_incremental_stream_is_idempotent(spark, tmp_path):
    df = views.tiles(spark, SF).select("tile_id", "sensor")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("tile_id % 2 = 0").write.parquet(src)
    for n in range(3):
        incremental.ingest_files(spark, src, df.schema, out, str(tmp_path / "cp"), ["tile_id"]).awaitTermination()
        if n == 0:
            df.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == df.count()


def test_change_point_stream_is_the_batch(spark):
    columns = ["series_id", "status", "onset", "confirmed", "uncertainty_days", "lag_days", "transients"]
    said, batch = catalog.QUERIES["change_point_stream"](spark, SF), catalog.QUERIES["change_point"](spark, SF)
    assert sorted(map(tuple, said.select(*columns).collect()), key=lambda r: r[0]) == sorted(map(tuple, batch.select(*columns).collect()), key=lambda r: r[0])


def test_windows(spark, tmp_path):
    import numpy as np

    from skyquilt.sources import windows

    a = np.arange(2 * 40 * 50).reshape(2, 40, 50)
    np.save(tmp_path / "a.npy", a)
    spark.dataSource.register(windows.SceneWindows)
    rows = spark.read.format("scene_windows").option("paths", str(tmp_path / "a.npy")).option("size", 32).load().collect()
    assert len(rows) == 4 and {(r["row_off"], r["col_off"]) for r in rows} == {(0, 0), (0, 32)}
    r = next(r for r in rows if r["col_off"] == 32 and r["band"] == 1)
    assert r["pixels"] == a[1, :32, 32:].ravel().astype(float).tolist()
