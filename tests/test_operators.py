import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import cluster, filters, merge, raster, series, spatial, vector


def passes(spark, scores, invalid=()):
    rows = [(1, dt.datetime(2026, 1, 1) + dt.timedelta(days=5 * i), float(s), i not in invalid) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, score double, valid boolean")


def machine(scores, invalid, n, k, threshold):
    """The rule pass by pass: status, onset and confirmed by index, and how many passes were transient."""
    valid = [(i, s) for i, s in enumerate(scores) if i not in invalid]
    if len(valid) <= n:
        return "insufficient_data", None, None, 0
    run, transient = [], 0
    for i, s in valid[n:]:
        if s >= threshold:
            run.append(i)
            if len(run) == k:
                return "confirmed", run[0], i, transient
        else:
            transient += len(run)
            run = []
    transient += len(run)
    return ("transient_only" if transient else "no_change"), None, None, transient


@pytest.mark.parametrize("scores,invalid,status,onset,confirmed", [
    ([0.02, 0.03, 0.04, 0.72, 0.81], (), "confirmed", 3, 4), ([0.02, 0.03, 0.04, 0.8, 0.1, 0.2], (), "transient_only", None, None),
    ([0.02, 0.03, 0.04, 0.75, 0.01, 0.82], (4,), "confirmed", 3, 5), ([0.1, 0.2, 0.8], (1,), "insufficient_data", None, None),
])
def test_change_point(spark, scores, invalid, status, onset, confirmed):
    r = series.change_points(passes(spark, scores, invalid), ["series_id"], "ts").collect()[0]
    day = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(days=5 * i) if i is not None else None
    assert (r["status"], r["onset"], r["confirmed"]) == (status, day(onset), day(confirmed))
    if status == "confirmed" and not invalid:
        assert (r["uncertainty_days"], r["lag_days"]) == (5.0, 5.0)


def test_change_point_against_machine(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        scores = [rng.random() for _ in range(rng.randint(1, 14))]
        invalid = {i for i in range(len(scores)) if rng.random() < 0.2}
        want[s] = machine(scores, invalid, 3, 2, 0.6)
        rows += [(s, dt.datetime(2026, 1, 1) + dt.timedelta(days=i), v, i not in invalid) for i, v in enumerate(scores)]
    df = spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, score double, valid boolean")
    for r in series.change_points(df, ["series_id"], "ts", 3, 2, 0.6).collect():
        status, onset, confirmed, transient = want[r["series_id"]]
        at = lambda t: None if t is None else (t - dt.datetime(2026, 1, 1)).days
        assert (r["status"], at(r["onset"]), at(r["confirmed"]), r["transients"]) == (status, onset, confirmed, transient)


def test_change_point_arguments(spark):
    with pytest.raises(ValueError):
        series.change_points(passes(spark, [0.1]), ["series_id"], "ts", persistence=1)


def test_band_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    pts = [(i, 88 + rng.random() * 0.1, 22 + rng.random() * 0.1) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {(r["id"], r["id_2"]) for r in spatial.band_join(df, df, 0.006).collect()}
    assert got == {(a, c) for a, x, y in pts for c, u, v in pts if abs(x - u) <= 0.006 and abs(y - v) <= 0.006}
    plan = spatial.band_join(df, df, 0.006)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygons(spark):
    ring = [(88.3, 22.5), (88.5, 22.5), (88.5, 22.7), (88.3, 22.7)]
    for shape in ({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Polygon", "coordinates": [ring]}, {"coordinates": [ring]}, ring, [ring]):
        assert filters.polygon_points(shape) == ring
    assert filters.polygon_points("no") is None and filters.polygon_points([]) is None and filters.polygon_points(None) is None
    df = spark.createDataFrame([(88.4, 22.6), (89.0, 22.0), (88.3, 22.6), (88.5, 22.7)], "lon double, lat double")
    assert df.where(filters.in_polygon(F.col("lon"), F.col("lat"), ring)).count() == 3


def test_boxes():
    assert filters.clipped_box((80, 20, 88, 22)) == (87.75, 21.40, 88, 22)
    for bad in ((89, 21, 88, 22), (10, 10, 11, 11)):
        with pytest.raises(ValueError):
            filters.clipped_box(bad)
    assert filters.meeting_box((0, 0, 1, 1), (5, 5, 6, 6)) == (5, 5, 6, 6)


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "MSI", 88.0, 22.0)], "tile_id int, sensor string, lon double, lat double")
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(sensor" in shown(t.where(filters.by_sensor(F.col("sensor"), "s2")).select("tile_id")).replace("IsNotNull(sensor), ", "")
    assert "GreaterThanOrEqual(lon,87.0)" in shown(t.where(filters.in_box(F.col("lon"), F.col("lat"), (87, 21, 89, 23))).select("tile_id"))


def test_top_k_and_embedding(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [r["id"] for r in vector.top_k(df, "v", vector.literal([1.0, 0.1]), 2, "id", F.col("id") < 4).collect()] == [1, 3]
    assert df.select(vector.unit(F.col("v")).isNull().alias("z")).where("z").count() == 1
    e = vector.with_text_embedding(spark.createDataFrame([("red roof",), ("",)], "t string"), "t").collect()
    assert len(e[0]["embedding"]) == vector.DIMS and abs(np.linalg.norm(e[0]["embedding"]) - 1) < 1e-5 and not any(e[1]["embedding"])


def test_average_linkage(spark):
    rng = np.random.default_rng(0)
    v = np.vstack([rng.normal([5, 0, 0], 0.1, (6, 3)), rng.normal([0, 5, 0], 0.1, (5, 3)), rng.normal([0, 0, 5], 0.1, (4, 3))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key int, v array<double>")
    labels = {r["key"]: r["label"] for r in cluster.average_linkage(rows, "key", "v", 3).collect()}
    assert [labels[i] for i in range(15)] == [0] * 6 + [1] * 5 + [2] * 4
    assert cluster.cluster_count(100, 8) == 8 and cluster.cluster_count(9, 8) == 3 and cluster.cluster_count(1, 8) == 1


def test_components_and_shift(spark):
    mask = np.zeros((6, 6))
    mask[0, 0] = mask[1, 1] = mask[4, 4] = 1
    labels = raster.label_components(mask > 0)
    assert labels[0, 0] == labels[1, 1] == 1 and labels[4, 4] == 2


def test_raster_values(spark):
    flat = [("a", r, c, 0.5) for r in range(16) for c in range(16)]
    checker = [("b", r, c, float((r + c) % 2)) for r in range(16) for c in range(16)]
    df = spark.createDataFrame(flat + checker, "tile_id string, row int, col int, value double")
    sharp = {r["tile_id"]: r["sharpness"] for r in raster.sharpness(df).collect()}
    assert sharp["a"] == 0.0 and sharp["b"] > 0.5
    small = raster.resample(df.where("tile_id = 'a'"), 8, 4)
    assert small.count() == 32 and small.where("abs(value - 0.5) > 1e-9").count() == 0
    rgb = spark.createDataFrame([(0.25, 0.55, 0.20), (0.92, 0.92, 0.92)], "r double, g double, b double")
    assert [r["c"] for r in rgb.select(raster.cloud_like(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()] == [False, True]
    i = raster.indices({"red": F.lit(0.2), "green": F.lit(0.9), "blue": F.lit(0.2)})
    assert spark.range(1).select(i["ndvi"].alias("x")).collect()[0]["x"] > 0.4
    with pytest.raises(Exception, match="feature shapes do not match"):
        spark.range(1).select(raster.feature_difference(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    long = raster.to_long(spark.createDataFrame([("t", "red", 2, [1.0, 2.0, 3.0, 4.0])], "tile_id string, band string, width int, pixels array<double>"))
    assert raster.to_arrays(long).collect()[0]["pixels"] == [1.0, 2.0, 3.0, 4.0]


def test_histogram_match_moves_the_mean(spark):
    rng = np.random.default_rng(42)
    make = lambda m: spark.createDataFrame([("red", float(v)) for v in np.clip(rng.normal(m, 0.1, 2000), 0, 1)], "band string, value double")
    src, ref = make(0.3), make(0.7)
    lut = raster.histogram_match(src, ref)
    out = src.withColumn("level", F.round(F.col("value") * 255).cast("int")).join(lut.withColumnRenamed("value", "level"), ["band", "level"])
    assert abs(out.agg(F.avg(F.col("matched") / 255)).collect()[0][0] - 0.7) < 0.05


def test_merge(spark):
    s = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "k int, t int, v string")
    n = spark.createDataFrame([(2, 1, "new", 5), (3, 1, "new", 6), (3, 1, "new", 6)], "k int, t int, v string, extra int")
    assert {r["k"]: r["v"] for r in merge.upserted(s, n, ["k"], "t").collect()} == {1: "old", 2: "new", 3: "new"}
    assert [r["k"] for r in merge.inserted(s, n, ["k"]).collect()] == [3]
    with pytest.raises(ValueError):
        merge.drop_tables(spark, ["x"])
    q = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "source_filename string, ingested_at timestamp_ntz")
    done = spark.createDataFrame([("a", dt.datetime(2024, 1, 2))], "source_filename string, ingested_at timestamp_ntz")
    assert [r["source_filename"] for r in merge.current_quarantine(q, done).collect()] == ["b"]


def test_image_embedding(spark):
    rng = np.random.default_rng(2)
    a = rng.random((8, 6, 3))
    rows = spark.createDataFrame([(a.ravel().tolist(), 6), (np.clip(a + 0.01, 0, 1).ravel().tolist(), 6), (np.zeros(144).tolist(), 6)], "p array<double>, w int")
    x, y, z = (np.array(r["embedding"]) for r in vector.with_image_embedding(rows, "p", "w").collect())
    assert abs(np.linalg.norm(x) - 1) < 1e-5 and x @ y > x @ z
