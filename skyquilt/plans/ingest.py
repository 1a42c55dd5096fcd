"""Ingestion of scenes into tiles, and the planning of acquisitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import scalar as S
from skyquilt.lineage import cut
from skyquilt.operators import filters, merge, raster, series, vector
from skyquilt.sources import files, rasters, stored

#: The area of ingestion, the least raster side and the least clear share of a tile.
AREA: filters.Box = (88.05, 22.20, 88.65, 22.95)
LEAST_SIDE, LEAST_CLEAR = 64, 0.20


def tiles_of(scenes: DataFrame, known: DataFrame, size: int = 256, area: filters.Box | None = AREA) -> DataFrame:
    """New tiles of readable scenes (`rasters.scenes` with source_hash and ts): windows, bounds in degrees, area test and ids, less the tiles that are known."""
    valid = scenes.where((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    rows = rasters.placed(valid, size)
    if area:
        rows = rows.where(filters.overlaps(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), area))
    return merge.inserted(known, merge.tile_ids(rows, "path"), ["tile_uuid"])


def ingested(paths: DataFrame, scenes: DataFrame, tiles: DataFrame, vectors: DataFrame, size: int = 256, area: filters.Box | None = AREA) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New scenes, their tiles, the pixels of these tiles, and the scenes to be repaired.

    paths: path and content of scene files; scenes: source_hash, scene_id, status; tiles: tile_uuid;
    vectors: scene_id. A file whose content an ingested scene has is not read again. Scenes have sensor
    and date by their file name (the TIFF's date first), and status `failed` with the error where
    they cannot be read. Tiles come from the tables, so a run that is repeated adds nothing.
    """
    fresh, repair = merge.scenes_to_ingest(paths.select("path", "content"), scenes, vectors)
    fresh = cut(fresh)
    read = rasters.scenes(fresh).join(fresh.select("path", "source_hash"), "path")
    sensor, day = files.name_parts(F.element_at(F.split("path", "/"), -1))
    stamp = F.try_to_timestamp("datetime", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    new = cut(read.withColumns({"sensor": sensor, "ts": F.coalesce(stamp, day), "status": F.when(F.col("error").isNull(), "ingested").otherwise("failed")}))
    own = cut(tiles_of(new.where("status = 'ingested'"), tiles, size, area))
    pixels = rasters.windows(fresh, size).join(own.select("path", "row_off", "col_off", "tile_uuid"), ["path", "row_off", "col_off"])
    return new, own, pixels, repair


#: The tables of a catalogue folder.
SCENES = "source_hash string, path string, sensor string, ts timestamp_ntz, status string, error string, height int, width int, bands int, epsg int"
TILES = (
    "tile_uuid string, source_hash string, path string, row_off int, col_off int, h int, w int, lon double, lat double, minx double, miny double, maxx double, maxy double, ts timestamp_ntz, sensor string, bands int, "
    "modality string, method string, clear double, valid_share double, confounds array<string>, sharpness double, cloud double, quality double"
)
VECTORS = "tile_uuid string, source_hash string, embedding array<float>"


def named_pixels(windows: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, sensor, row, col, band (by name, of those that the scene's sensor or number of bands tells), value of tiles' windows."""
    known = files.band_map(F.lit(None).cast("string"), F.col("sensor"), F.col("bands"))
    rows = windows.join(tiles.select("tile_uuid", "sensor", "bands"), "tile_uuid").withColumn("_names", F.map_entries(known))
    name = F.get(F.filter("_names", lambda e: e["value"] == F.col("band")), F.lit(0))["key"]
    rows = rows.withColumn("band", F.coalesce(name, F.concat(F.lit("band "), F.col("band").cast("string"))))
    return raster.to_long(rows.withColumnRenamed("tile_uuid", "tile_id"), width="w", keep=("sensor",))


def embedded(pixels: DataFrame) -> DataFrame:
    """tile_uuid and embedding of the tiles that have light bands, by the placeholder embedding of images."""
    light = raster.scaled(pixels.where(F.col("band").isin("red", "green", "blue")).select("tile_id", "row", "col", "band", "value"))
    return vector.with_image_embedding(raster.to_images(light), "image", "width").select(F.col("tile_id").alias("tile_uuid"), "embedding")


def run(paths: DataFrame, folder: str, batch: str, size: int = 256, area: filters.Box | None = AREA) -> DataFrame:
    """Take scene files (path, content) into the catalogue of a folder; returns the tiles made, with discard_reasons of those that were not kept.

    Its tables `scenes`, `tiles` and `vectors` are `stored` ones. Scenes of known content are not read again, tiles under the
    least clear share are not kept, and tiles that lack a vector get it again from their scene's file, if it is among the paths.
    Tiles are committed before scenes: a run that is lost in between is made up for by running the
    batch again, or any later one with these files; a batch that is run twice counts once.
    """
    spark = paths.sparkSession
    scenes = stored.current(spark, f"{folder}/scenes", ["source_hash"], SCENES)
    tiles = stored.current(spark, f"{folder}/tiles", ["tile_uuid"], TILES)
    vectors = stored.current(spark, f"{folder}/vectors", ["tile_uuid"], VECTORS)
    scene_ids = lambda df: df.withColumn("scene_id", F.col("source_hash"))
    new, own, windows, _ = ingested(paths, scene_ids(scenes), tiles, scene_ids(vectors), size, area)
    pixels = cut(named_pixels(windows, own))
    said = judged(pixels).drop("speckle", "speckle_quality")
    made = cut(own.join(said.withColumnRenamed("tile_id", "tile_uuid"), "tile_uuid"))
    kept = made.where("discard_reasons is null")
    stored.commit(kept.select(*_names(TILES)), f"{folder}/tiles", batch, ["tile_uuid"])
    # vectors of new tiles, and of those that lack one
    lacking = cut(stored.current(spark, f"{folder}/tiles", ["tile_uuid"], TILES).join(vectors.select("tile_uuid"), "tile_uuid", "left_anti"))
    again = lacking.join(kept.select("tile_uuid"), "tile_uuid", "left_anti")
    hashed = paths.select("path", "content", F.sha2("content", 256).alias("source_hash")).dropDuplicates(["source_hash"])
    hashed = hashed.join(again.select("source_hash").distinct(), "source_hash", "left_semi")
    read = rasters.windows(hashed.select("path", "content"), size).join(hashed.select("path", "source_hash"), "path").drop("path")
    old = read.join(again.select("source_hash", "row_off", "col_off", "tile_uuid"), ["source_hash", "row_off", "col_off"])
    every = pixels.join(lacking.select(F.col("tile_uuid").alias("tile_id")), "tile_id", "left_semi").unionByName(named_pixels(old, again))
    found = embedded(every).join(lacking.select("tile_uuid", "source_hash"), "tile_uuid")
    stored.commit(found.select(*_names(VECTORS)), f"{folder}/vectors", batch, ["tile_uuid"])
    stored.commit(new.select(*_names(SCENES)), f"{folder}/scenes", batch, ["source_hash"])
    return made


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def tile_quality(pixels: DataFrame) -> DataFrame:
    """Per tile: clear, cloud and valid shares, the quality score and whether it is gated out, with the reason. pixels: a row per pixel with red, green, blue."""
    valid = F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull() & ((F.col("red") + F.col("green") + F.col("blue")) > 0)
    cloud = F.coalesce(raster.cloud_like(F.col("red"), F.col("green"), F.col("blue")), F.lit(False))
    out = pixels.groupBy("tile_id").agg(raster.fraction(valid).alias("valid_share"), raster.fraction(cloud).alias("cloud"), raster.fraction(valid & ~cloud).alias("clear"))
    out = out.withColumn("quality", F.round(S.quality_score(F.col("cloud"), F.col("valid_share"), S.num(0.5)), 6))
    return out.withColumn("discard_reason", F.when(F.col("clear") < LEAST_CLEAR, "low_clear_fraction"))


def judged(pixels: DataFrame, nodata: float = 0.0) -> DataFrame:
    """The tiles' masks (`raster.quality_masks`) with cloud, sharpness, quality, and discard_reasons where the tile is gated out.

    A tile under the least clear share is gated out for its confounds, or for its low clear share if it has none.
    Sharpness is of the mean of red, green and blue scaled to 0..1, missing ones as 0; a tile without them has none and counts as 0.
    """
    _, masks = raster.quality_masks(pixels, nodata)
    rgb = raster.scaled(pixels.where(F.col("band").isin("red", "green", "blue") & F.col("value").isNotNull()).select("tile_id", "row", "col", "band", "value"))
    grey = rgb.groupBy("tile_id", "row", "col").agg((F.sum("value") / 3).alias("value"))
    out = masks.join(raster.sharpness(grey), "tile_id", "left").withColumn("cloud", S.num(1) - F.col("clear"))
    out = out.withColumn("quality", S.quality_score(F.col("cloud"), F.col("valid_share"), F.coalesce("sharpness", S.num(0))))
    return out.withColumn("discard_reasons", F.when(F.col("clear") < LEAST_CLEAR, F.when(F.size("confounds") > 0, F.col("confounds")).otherwise(F.array(F.lit("low_clear_fraction")))))


def scene_rollup(tiles: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return tiles.groupBy("scene_id").agg(F.count("*").alias("tile_count"), (F.sum(F.coalesce("cloud", S.num(0))) / n).alias("cloud"), (F.sum(F.coalesce("quality", S.num(0))) / n).alias("quality"))


def discard_histogram(tiles: DataFrame, reasons: str = "confounds") -> DataFrame:
    """reason, n; a tile without a reason counts as low_clear_fraction."""
    listed = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.col(reasons)).otherwise(F.array(F.lit("low_clear_fraction")))
    return tiles.select(F.explode(listed).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def plan_acquisitions(bounds: DataFrame, catalog: DataFrame, have: DataFrame, days: int = 5) -> DataFrame:
    """For each window without a scene that we have: the least cloudy online scene, or a gap.

    bounds: first, final; catalog: product_id, date, cloud, online; have: date.
    """
    windows = filters.uncovered(series.cadence(bounds, days).select("start", "stop"), have)
    by_day = windows.select("start", "stop", F.explode(F.sequence("start", "stop")).alias("_day"))
    online = catalog.where("online").withColumn("_day", F.to_date("date"))
    w = Window.partitionBy("start").orderBy(F.coalesce("cloud", S.num(0)), "date", "product_id")
    best = by_day.join(online, "_day").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("start", "product_id", "date", "cloud")
    return windows.join(best, "start", "left").withColumn("state", F.when(F.col("product_id").isNull(), "gap").otherwise("acquire"))


def acquisition_report(plans: DataFrame) -> DataFrame:
    return plans.groupBy("source").agg(F.count("*").alias("windows"), F.count_if(F.col("state") == "acquire").alias("found"), F.count_if(F.col("state") == "gap").alias("gaps"))


