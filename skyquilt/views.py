"""Stand-in views of the catalogue's tables over the benchmark tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.ship import ship

#: Some landmarks of the area (order, name, zone, longitude, latitude, kind).
LANDMARKS = (
    (0, "Esplanade", "Central Kolkata", 88.3526, 22.5645, "commercial_transit"),
    (1, "Hooghly River / Ganges Waterway", "River Corridor", 88.3450, 22.5800, "waterway"),
    (2, "BBD Bagh / Dalhousie", "Central Kolkata", 88.3490, 22.5728, "civic_commercial"),
    (3, "Maidan / Victoria Memorial", "Central Kolkata", 88.3426, 22.5448, "civic_park"),
    (4, "Park Street / Chowringhee", "Central Kolkata", 88.3540, 22.5510, "commercial_hub"),
)

#: Images of `scene_pixels` that one task makes.
TILES_OF_A_TASK = 64
#: Line items that one task turns into pixels, about.
ITEMS_OF_A_TASK = 300_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _share(key, by: int, over: float):
    return (key % by) / F.lit(over)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("tile_id"), c.alias("scene_id"), F.col("o_orderdate").alias("ts"),
        (F.lit(87.75) + (c % 90) * F.lit(0.0097) + (k % 7) * F.lit(0.0001)).alias("lon"),
        (F.lit(21.4) + F.floor(c / F.lit(90.0)) * F.lit(0.0129) + (k % 5) * F.lit(0.0001)).alias("lat"),
        F.when(k % 3 == 0, "MSI").when(k % 3 == 1, "SAR-C").otherwise("OLI").alias("sensor"),
        F.when(k % 11 != 0, _share(k, 101, 100.0)).alias("cloud"), F.when(k % 13 != 0, _share(k, 97, 97.0)).alias("quality"),
        (_share(k, 41, 50.0) - F.lit(0.3)).alias("ndvi"), (_share(k, 43, 60.0) - F.lit(0.4)).alias("ndwi"), (_share(k, 47, 70.0) - F.lit(0.35)).alias("ndbi"), (k % 251).cast("double").alias("brightness"),
        (k % 4).cast("int").alias("row_off"), (k % 3).cast("int").alias("col_off"),
    )


TILES = """tiles AS (
  SELECT o_orderkey AS tile_id, o_custkey AS scene_id, o_orderdate AS ts,
    8775e-2 + (o_custkey % 90) * 97e-4 + (o_orderkey % 7) * 1e-4 AS lon, 214e-1 + floor(o_custkey / 90e0) * 129e-4 + (o_orderkey % 5) * 1e-4 AS lat,
    CASE o_orderkey % 3 WHEN 0 THEN 'MSI' WHEN 1 THEN 'SAR-C' ELSE 'OLI' END AS sensor,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 101) / 100e0 END AS cloud, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 97) / 97e0 END AS quality,
    (o_orderkey % 41) / 50e0 - 3e-1 AS ndvi, (o_orderkey % 43) / 60e0 - 4e-1 AS ndwi, (o_orderkey % 47) / 70e0 - 35e-2 AS ndbi, CAST(o_orderkey % 251 AS DOUBLE) AS brightness,
    CAST(o_orderkey % 4 AS INTEGER) AS row_off, CAST(o_orderkey % 3 AS INTEGER) AS col_off
  FROM orders)"""


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("scene_id"), F.col("c_name").alias("source_filename"), F.col("c_mktsegment").alias("sensor"), F.when(F.col("c_acctbal") >= 0, "ingested").otherwise("quarantined").alias("status"))


SCENES = "scenes AS (SELECT c_custkey AS scene_id, c_name AS source_filename, c_mktsegment AS sensor, CASE WHEN c_acctbal >= 0 THEN 'ingested' ELSE 'quarantined' END AS status FROM customer)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with the columns of the tile of the same number."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id"), "embedding", "label")
    return v.join(tiles(spark, sf), "tile_id")


VECTORS = f"{TILES}, vectors AS (SELECT tiles.*, embedding, label FROM embeddings JOIN tiles ON vec_id = tile_id)"


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    verdict = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type").isin("click", "purchase"), "confirm").otherwise("uncertain")
    kind = F.when(F.col("event_id") % 2 == 0, "change_result").otherwise("tile")
    return e.select(F.col("event_id").alias("feedback_id"), kind.alias("target_type"), (F.col("event_id") % 500).alias("target_id"), verdict.alias("verdict"), F.col("ts").alias("created_at"))


FEEDBACK = """feedback AS (SELECT event_id AS feedback_id, CASE WHEN event_id % 2 = 0 THEN 'change_result' ELSE 'tile' END AS target_type, event_id % 500 AS target_id,
    CASE WHEN event_type = 'error' THEN 'reject' WHEN event_type IN ('click', 'purchase') THEN 'confirm' ELSE 'uncertain' END AS verdict, ts AS created_at FROM events)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Change results: each order of a customer and the customer's next one."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    k = F.col("o_orderkey")
    rows = o.withColumn("after_tile_id", after).where("after_tile_id is not null")
    return rows.select(
        k.alias("change_id"), k.alias("before_tile_id"), "after_tile_id", F.when(k % 3 == 0, F.concat(F.lit("a"), (k % 400).cast("string"))).alias("analysis_key"),
        _share(k, 89, 89.0).alias("change_score"), F.when(k % 17 != 0, _share(k, 83, 83.0)).alias("confidence"),
        F.when(k % 2 == 0, "dense-multitemporal-change-point").otherwise("bi-temporal").alias("method"),
        F.when(k % 5 == 0, "no_change").when(k % 5 == 1, "transient_only").otherwise("confirmed").alias("persistence_status"), F.col("o_orderdate").alias("created_at"),
    )


RESULTS = """results AS (SELECT o_orderkey AS change_id, o_orderkey AS before_tile_id, after_tile_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || CAST(o_orderkey % 400 AS VARCHAR) END AS analysis_key,
    (o_orderkey % 89) / 89e0 AS change_score, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 83) / 83e0 END AS confidence,
    CASE WHEN o_orderkey % 2 = 0 THEN 'dense-multitemporal-change-point' ELSE 'bi-temporal' END AS method,
    CASE o_orderkey % 5 WHEN 0 THEN 'no_change' WHEN 1 THEN 'transient_only' ELSE 'confirmed' END AS persistence_status, o_orderdate AS created_at
  FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after_tile_id FROM orders) WHERE after_tile_id IS NOT NULL)"""


def passes(spark: SparkSession, sf: str) -> DataFrame:
    return of_events(table(spark, sf, "events"))


def of_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("score"), (F.col("event_type") != "error").alias("valid"), "event_id")


PASSES = "passes AS (SELECT user_id AS series_id, ts, value AS score, event_type <> 'error' AS valid, event_id FROM events)"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Long-form pixels: a 32 x 32 tile for each supplier of the line items, four bands by line number, means where items meet."""
    li = table(spark, sf, "lineitem")
    band = F.element_at(F.array(*[F.lit(b) for b in ("blue", "green", "red", "nir")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = li.select(F.col("l_suppkey").alias("tile_id"), (F.col("l_partkey") % 32).cast("int").alias("row"), (F.col("l_orderkey") % 32).cast("int").alias("col"), band.alias("band"), ((F.col("l_quantity") * 5) % 256).alias("value"))
    # tiles are dealt once, over tasks that grow in number and not in size, and all that groups by tile stays there
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // ITEMS_OF_A_TASK))
    return rows.repartition(parts, "tile_id").groupBy("tile_id", "row", "col", "band").agg(F.max("value").alias("value"))


PIXELS = """pixels AS (SELECT l_suppkey AS tile_id, CAST(l_partkey % 32 AS INTEGER) AS "row", CAST(l_orderkey % 32 AS INTEGER) AS col,
    CASE l_linenumber % 4 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' WHEN 2 THEN 'red' ELSE 'nir' END AS band, max((l_quantity * 5) % 256) AS "value" FROM lineitem GROUP BY ALL)"""


def image_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles of the pixel view, a pass every day."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("tile_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(k.cast("int"))).alias("ts"), F.when(k % 7 == 0, "sar").otherwise("optical").alias("mode"),
        (F.lit(0.3) + _share(k, 60, 100.0)).alias("quality"), _share(k, 30, 100.0).alias("cloud"), (F.lit(0.7) + _share(k, 25, 100.0)).alias("valid_share"),
    )


def scene_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """A pass every 16 days over each of the areas that eight suppliers share; every 25th supplier is an area of its own with a single pass."""
    k = F.col("s_suppkey")
    single = k % 25 == 0
    area = F.when(single, 1_000_000_000 + k).otherwise(F.floor(k / 8))
    return table(spark, sf, "supplier").select(
        k.alias("tile_id"), area.cast("long").alias("area_id"), F.when(single, 0).otherwise(k % 8).cast("int").alias("pass"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 8 * 16).cast("int"))).alias("ts"), F.lit("optical").alias("mode"),
        F.when((area % 4 == 3) & (k % 8 > 1), 0.2).otherwise(F.lit(0.6) + _share(k, 30, 100.0)).alias("quality"), _share(k, 20, 100.0).alias("cloud"), (F.lit(0.9) + _share(k, 10, 100.0)).alias("valid_share"),
        F.col("s_nationkey").alias("nation"),
    )


def scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Dense 48 x 48 images of `scene_tiles`, four bands in 0..1: fields of an area's own levels, seen a pixel further down in every fifth pass.

    From pass 5 on, the right half of two areas in three is another surface: built ground, or water.
    The few bytes of the tiles' file are dealt out before they become pixels, and pixels are never broadcast.
    """
    side = 48
    t = scene_tiles(spark, sf)
    parts = max(spark.sparkContext.defaultParallelism, -(-t.count() // TILES_OF_A_TASK))
    t = t.select("tile_id", "area_id", "pass").repartition(parts, "tile_id").select("tile_id", "area_id", "pass", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("_i"))
    t = t.withColumn("row", F.floor(F.col("_i") / side).cast("int")).withColumn("col", (F.col("_i") % side).cast("int"))
    share = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000
    # what the bands share is a column, worked out once a pixel: written out for each band and surface, it makes a method that Java does not compile
    t = t.withColumn("_seen", F.col("row") + F.when(F.col("tile_id") % 5 == 0, 1).otherwise(0))
    level = F.when(share("area_id", F.floor(F.col("_seen") / 16), F.floor(F.col("col") / 16)) < 0.5, 0.05).otherwise(0.85)
    t = t.withColumns({
        "_field": level + 0.15 * share("area_id", F.lit(1), F.floor(F.col("_seen") / 7), F.floor((F.col("col") + F.col("_seen") % 7 / 3) / 6)),
        "_noise": (share("tile_id", "row", "col") - 0.5) * 0.02,
        "_turned": F.when((F.col("pass") >= 5) & (F.col("area_id") % 3 > 0) & (F.col("col") >= 24), F.col("area_id") % 3).otherwise(0),
    })
    # least and span of each band over growing fields, built ground and water
    green, built, water = {"blue": (0.04, 0.06), "green": (0.06, 0.14), "red": (0.04, 0.16), "nir": (0.25, 0.60)}, {"blue": (0.02, 0.08), "green": (0.04, 0.16), "red": (0.05, 0.20), "nir": (0.20, 0.10)}, {"blue": (0.08, 0.02), "green": (0.16, 0.04), "red": (0.03, 0.01), "nir": (0.01, 0.01)}
    field, turned = F.col("_field"), F.col("_turned")
    value = lambda b: F.when(turned == 1, built[b][0] + (1 - field) * built[b][1]).when(turned == 2, water[b][0] + (1 - field) * water[b][1]).otherwise(green[b][0] + field * green[b][1]) + F.col("_noise")
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), value(b).alias("value")) for b in green]))
    return t.select("tile_id", "row", "col", bands.alias("_b")).select("tile_id", "row", "col", "_b.band", "_b.value").hint("merge")


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANDMARKS), "ord int, name string, zone string, lon double, lat double, feature_type string")


GAZETTEER = "gazetteer(ord, name, zone, glon, glat, feature_type) AS (VALUES " + ", ".join(f"({o}, '{n}', '{z}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), '{k}')" for o, n, z, x, y, k in LANDMARKS) + ")"
