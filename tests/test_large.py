"""Plans and results that only larger tables would show: no side collected by the driver on a guess, ranges over the pole."""

import math

from pyspark.sql import functions as F

from skyquilt import catalog, views
from skyquilt.operators import cluster, index, nearest, spatial


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_band_join_broadcasts_no_table(spark):
    rows = spark.range(50).select(F.col("id").alias("tile_id"), (F.col("id") * 0.001).alias("lon"), F.lit(1.0).alias("lat"))
    met = spatial.band_join(rows, rows, 0.006)
    assert "Broadcast" not in physical(met)
    assert met.count() == sum(abs(a * 0.001 - b * 0.001) <= 0.006 for a in range(50) for b in range(50))


def test_change_evidence_broadcasts_no_table(spark):
    met = catalog.QUERIES["change_evidence"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in physical(met) and met.count() == 1500


def test_slippy_tiles_over_the_pole_as_in_sql(spark, tmp_path):
    import duckdb

    # customers whose boxes end below, lie across and lie above 90 degrees
    keys = [0, 400_000, 478_500, 478_590, 478_680, 478_770, 600_000]
    spark.createDataFrame([(k,) for k in keys], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    con.execute(catalog.ORACLES["slippy_tiles"])
    assert sorted(map(tuple, catalog.QUERIES["slippy_tiles"](spark, str(tmp_path)).collect())) == sorted(con.fetchall())
    box = spark.createDataFrame([(1.0, 89.98, 1.05, 90.03)], "west double, south double, east double, north double")
    assert spatial.slippy_tiles(box, [10]).count() == 0
    # asinh(tan(90.0001 degrees)) to 12 digits, where a plain logarithm has four
    y = spark.range(1).select(spatial.slippy_y(F.lit(90.0001), F.lit(22))).collect()[0][0]
    assert y == math.floor((1 - math.asinh(math.tan(math.radians(90.0001))) / math.pi) / 2 * 2**22)


def test_average_linkage_in_parts_as_in_one(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    made = (rng.standard_normal((12, 8))[rng.integers(0, 12, 400)] + 0.4 * rng.standard_normal((400, 8))).astype(float)
    made[50:60] = made[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "key long, v array<double>")
    one, parts = (sorted(map(tuple, cluster.average_linkage(rows, "key", "v", 10, size, last).collect())) for size, last in ((1000, 1000), (40, 150)))
    assert one == parts and len({label for _, label in one}) == 10
    # both ways to merge what lies in one task give the same heights
    total, n = made[:100].copy() / np.linalg.norm(made[:100], axis=1)[:, None], np.ones(100)
    chain = cluster.chained(total, n)
    rounds = cluster.merged_within(total, n, np.full(100, np.inf), np.zeros((0, 2), int))
    assert len(chain) == 99 and np.allclose(sorted(h for *_, h in chain), sorted(h for *_, h in rounds))


def test_pixels_are_dealt_over_more_tasks_as_items_grow(spark, monkeypatch):
    monkeypatch.setattr(views, "ITEMS_OF_A_TASK", 500)
    assert views.pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 12
    monkeypatch.setattr(views, "TILES_OF_A_TASK", 1)
    tiles = views.scene_tiles(spark, "/root/testdata/sf0.001").count()
    assert views.scene_pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == max(4, tiles)


def test_far_points_meet_few_landmarks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    marks = np.stack([rng.uniform(87.75, 88.62, 40_000), rng.uniform(21.4, 21.6, 40_000)], 1)
    # among the landmarks, far to the north, over the pole and on the other side of the globe
    points = np.stack([rng.uniform(87.75, 88.65, 400), np.concatenate([rng.uniform(21.4, 21.6, 50), rng.uniform(22, 89, 250), rng.uniform(90.5, 150, 80), rng.uniform(-60, -20, 20)])], 1)
    made = spark.createDataFrame([(i, f"m{i}", "z", float(x), float(y), "k") for i, (x, y) in enumerate(marks)], "ord int, name string, zone string, lon double, lat double, feature_type string").cache()
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "tile_id int, lon double, lat double").cache()
    (x, y), (u, v) = np.radians(points.T)[:, :, None], np.radians(marks.T)[:, None, :]
    h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2
    km = 6371 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    got = {r["tile_id"]: (int(r["name"][1:]), r["distance_km"]) for r in spatial.nearest_landmark(rows, made).select("tile_id", "name", "distance_km").collect()}
    assert len(got) == len(points) and all(abs(km[i].min() - d) < 1e-9 * max(1, d) and km[i, n] - km[i].min() < 1e-9 for i, (n, d) in got.items())
    # of 40 blocks and more, a point meets few; a far one met all landmarks before
    blocks = nearest.blocks_of(made).cache()
    boxes = nearest.boxes_of(blocks)
    first = nearest.answered(nearest.first_asked(rows, boxes), blocks, 2).cache()
    asked = lambda asks: asks.selectExpr("sum(size(lon))").collect()[0][0]
    assert len(boxes.block) >= 40 and asked(first) == len(points) and asked(nearest.further_asked(first, boxes)) < len(boxes.block) * len(points) / 5


def test_queries_of_an_index_stay_off_the_driver(spark, tmp_path, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16))
    v[300:340], v[400] = v[5], 0.0
    rows = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "tile_id int, embedding array<double>, kind string")
    built = index.build(rows, "embedding", "tile_id", str(tmp_path / "i"), ["kind"])
    # two queries share an id; queries are not collected, whatever their number
    asked = rows.where("tile_id % 4 = 0").select((F.col("tile_id") - F.when(F.col("tile_id") == 8, 4).otherwise(0)).alias("query_id"), "embedding", "tile_id")

    def refused(*_):
        raise AssertionError("queries come to the driver")

    monkeypatch.setattr(type(asked), "toLocalIterator", refused)
    monkeypatch.setattr(index, "HELD", 50 * 16 * 4)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    unit = unit.astype(np.float32).astype(float)
    for keep, may in ((None, np.arange(600) != 400), (F.col("kind") == "a", (np.arange(600) % 2 == 0) & (np.arange(600) != 400))):
        found = index.search_many(built, asked, "query_id", "embedding", 7, keep, probes=len(built.centroids))
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["place"], r["tile_id"], r["similarity"]))
        assert sorted(got) == [i for i in range(0, 600, 4) if i not in (8, 400)] and len(got[4]) == 14
        for q in set(got) - {4}:
            score = (unit * unit[q]).sum(1)
            want = sorted(np.flatnonzero(may).tolist(), key=lambda i: (-score[i], i))[:7]
            assert [i for _, i, _ in sorted(got[q])] == want and all(abs(s - score[i]) < 1e-12 for _, i, s in got[q])
