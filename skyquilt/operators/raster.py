"""Raster operators on long-form pixels (tile_id, row, col, band, value) and, where a stencil or a search needs it, per tile in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.scalar import clip, num

#: Side of a feature patch, bands of the model input in order, and scene classes that are clear.
PATCH = 16
MODEL_BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
CLEAR_CLASSES = (4, 5, 6, 7)


def to_long(tiles: DataFrame, array: str = "pixels", width: str = "width", band: str = "band", keep: tuple[str, ...] = ()) -> DataFrame:
    """tile_id, what is to be kept, row, col, band, value from one array a band, row by row."""
    rows = tiles.select("tile_id", *keep, band, width, F.posexplode(array).alias("_i", "value"))
    return rows.select("tile_id", *keep, F.floor(F.col("_i") / F.col(width)).cast("int").alias("row"), (F.col("_i") % F.col(width)).cast("int").alias("col"), F.col(band).alias("band"), F.col("value").cast("double").alias("value"))


def to_images(pixels: DataFrame) -> DataFrame:
    """tile_id, image (red, green and blue in turn, row by row, missing values as 0) and width, of full grids of pixels."""
    rgb = wide(pixels, ["red", "green", "blue"])
    listed = F.array_sort(F.collect_list(F.struct("row", "col", *[F.coalesce(b, num(0)).alias(b) for b in ("red", "green", "blue")])))
    return rgb.groupBy("tile_id").agg(F.flatten(F.transform(listed, lambda x: F.array(x["red"], x["green"], x["blue"]))).alias("image"), (F.max("col") + 1).alias("width"))


def to_arrays(pixels: DataFrame) -> DataFrame:
    """One row per tile and band: height, width and the values row by row."""
    packed = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return pixels.groupBy("tile_id", "band").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.transform(packed, lambda s: s["value"]).alias("pixels"))


def scaled(pixels: DataFrame) -> DataFrame:
    """Values to 0..1: by 255 or 10,000 according to the tile's largest value."""
    top = pixels.groupBy("tile_id").agg(F.max("value").alias("_top"))
    by = F.when(F.col("_top") <= 1, num(1)).when(F.col("_top") <= 255, num(255)).otherwise(num(10000))
    return pixels.join(top, "tile_id").withColumn("value", F.col("value") / by).drop("_top")


def wide(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """One row per pixel with a column per band."""
    return pixels.groupBy("tile_id", "row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """a / b in -1..1 with a tiny b replaced."""
    return clip(a / F.when(F.abs(b) < eps, num(eps)).otherwise(b), -1, 1)


def indices(bands: dict[str, Column]) -> dict[str, Column]:
    """ndvi, ndwi and ndbi from the bands at hand; red, green and blue alone give the visible-light stand-ins."""
    zero = num(0)
    red, green, blue = (bands.get(b, zero) for b in ("red", "green", "blue"))
    if "nir" in bands and "red" in bands:
        nir = bands["nir"]
        built = ratio(bands["swir1"] - nir, bands["swir1"] + nir) if "swir1" in bands else ratio(red - nir, red + nir)
        return {"ndvi": ratio(nir - red, nir + red), "ndwi": ratio(green - nir, green + nir), "ndbi": built}
    brightness = (red + green + blue) / 3
    return {"ndvi": ratio(green - red, green + red - blue), "ndwi": ratio(blue - red, blue + red), "ndbi": ratio(red - green, red + green) * 0.5 + (brightness - 0.5)}


def stretched(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values to 0..1 between the joint exact percentiles of a tile's bands."""
    p = pixels.groupBy("tile_id").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    hi = F.when(hi - lo < 1e-6, lo + 1).otherwise(hi)
    return pixels.join(p, "tile_id").withColumn("value", clip((F.col("value") - lo) / (hi - lo))).drop("_p")


def median_baseline(pixels: DataFrame) -> DataFrame:
    """Per place and band the median over a stack's passes, without missing values and NaN."""
    v = F.when(F.isnan("value"), F.lit(None).cast("double")).otherwise(F.col("value"))
    return pixels.groupBy("series_id", "row", "col", "band").agg(F.median(v).alias("value"))


def band_stats(pixels: DataFrame, key: list[str]) -> DataFrame:
    return pixels.groupBy(*key).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def cloud_like(red: Column, green: Column, blue: Column) -> Column:
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return ((red + green + blue) / 3 > 0.75) & ((top - low) / (top + 1e-6) < 0.15)


def fraction(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def mask_valid(value: Column, nodata: float = 0.0, scene_class: Column | None = None) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (value != nodata)
    return ok if scene_class is None else ok & scene_class.isin(*CLEAR_CLASSES)


def histogram_match(source: DataFrame, target: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, band, value, matched: for each 8-bit value of the source the first target value whose share of smaller-or-equal pixels is nearest.

    Both sides are counts of at most 256 values a band (of each pair of images, if `keys`
    tell several); source shares find the target shares below and above by one sort.
    """
    by = [*keys, "band"]

    def share(pixels: DataFrame) -> DataFrame:
        level = F.least(F.greatest(F.round(F.col("value") * 255), F.lit(0)), F.lit(255)).cast("int")
        counts = pixels.groupBy(*by, level.alias("v")).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*by)
        return counts.withColumn("c", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).drop("n")

    goal = share(target)
    # below the first level that occurs the share is 0, from level 0 on
    start = goal.groupBy(*by).agg(F.min("v").alias("_least")).where("_least > 0").select(*by, F.lit(0).alias("v"), F.lit(0.0).alias("c"))
    points = goal.unionByName(start).select(*by, "c", F.lit(0).alias("_side"), F.lit(None).cast("int").alias("value"), F.struct("c", "v").alias("_t"))
    asked = share(source).join(goal.select(*by).distinct(), by, "left_semi").select(*by, "c", F.lit(1).alias("_side"), F.col("v").alias("value"), F.lit(None).cast("struct<c:double,v:int>").alias("_t"))
    w = Window.partitionBy(*by).orderBy("c", "_side", "value")
    rows = points.unionByName(asked)
    rows = rows.withColumn("_low", F.last("_t", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_high", F.first("_t", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    nearer = F.col("_high.c").isNull() | (F.abs(F.col("_low.c") - F.col("c")) <= F.abs(F.col("_high.c") - F.col("c")))
    return rows.where("_side = 1").select(*by, "value", F.when(F.col("_low.c").isNotNull() & nearer, F.col("_low.v")).otherwise(F.col("_high.v")).alias("matched"))


def patch_features(pixels: DataFrame, patch: int = PATCH) -> DataFrame:
    """tile_id, pi, pj, band, mean, std and edge (mean absolute step along rows and columns inside the patch)."""
    rows = pixels.withColumn("pi", F.floor(F.col("row") / patch).cast("int")).withColumn("pj", F.floor(F.col("col") / patch).cast("int"))
    inside = ["tile_id", "band", "pi", "pj"]
    right = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*inside, "row").orderBy("col")))
    down = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*inside, "col").orderBy("row")))
    rows = rows.withColumn("_r", right).withColumn("_d", down)
    return rows.groupBy(*inside).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.coalesce(F.avg("_r"), num(0)) + F.coalesce(F.avg("_d"), num(0))).alias("edge"))


def feature_difference(a: Column, b: Column) -> Column:
    """Relative distance of two feature vectors; vectors of different length are an error."""
    sq = lambda x: F.aggregate(x, num(0), lambda s, v: s + v.cast("double") * v.cast("double"))
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), num(0), lambda s, v: s + v)
    out = clip(F.sqrt(d) / (F.sqrt(sq(a)) + F.sqrt(sq(b)) + num(1e-6)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("feature shapes do not match")).cast("double")).otherwise(out)


def model_input(bands: Column) -> Column:
    """The six bands of a map of arrays in fixed order, or null if one is missing."""
    values = F.array(*[F.try_element_at(bands, F.lit(b)) for b in MODEL_BANDS])
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def correlation(pixels: DataFrame, key: list[str], a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """Correlation with `eps` on each deviation, so that flat images give 0 and no error."""
    return pixels.groupBy(*key).agg((F.covar_pop(a, b) / ((F.stddev_pop(a) + eps) * (F.stddev_pop(b) + eps))).alias("correlation"))


def region_stats(pixels: DataFrame, key: list[str], least: int = 1) -> DataFrame:
    """area, box, centroid, aspect, solidity, elongation and mean deltas of labelled regions of at least `least` pixels."""
    out = pixels.groupBy(*key).agg(
        F.count("*").alias("area"), F.min("row").alias("y"), F.min("col").alias("x"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"),
        F.avg("row").alias("cy"), F.avg("col").alias("cx"), F.var_samp("row").alias("_a"), F.var_samp("col").alias("_c"), F.covar_samp("row", "col").alias("_b"),
        *[F.avg(c).alias(c) for c in ("d_ndvi", "d_ndwi", "d_ndbi") if c in pixels.columns],
    ).where(F.col("area") >= least)
    aspect = F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w"))
    mid, half = (F.col("_a") + F.col("_c")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, num(2)) + F.col("_b") * F.col("_b"))
    long = F.sqrt(F.greatest(mid + half, num(1e-6)) / F.greatest(mid - half, num(1e-6)))
    return out.withColumn("aspect", aspect).withColumn("solidity", F.col("area") / (F.col("w") * F.col("h"))).withColumn("elongation", F.when(F.col("area") >= 6, long).otherwise(aspect)).drop("_a", "_b", "_c")


def _grid(pdf: pd.DataFrame, value: str = "value") -> np.ndarray:
    out = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1))
    out[pdf["row"], pdf["col"]] = pdf[value]
    return out


def label_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 in scan order."""
    height, width = mask.shape
    labels = np.zeros(mask.shape, int)
    n = 0
    for r, c in zip(*np.nonzero(mask)):
        if labels[r, c]:
            continue
        n += 1
        labels[r, c] = n
        stack = [(r, c)]
        while stack:
            y, x = stack.pop()
            for yy in range(max(0, y - 1), min(height, y + 2)):
                for xx in range(max(0, x - 1), min(width, x + 2)):
                    if mask[yy, xx] and not labels[yy, xx]:
                        labels[yy, xx] = n
                        stack.append((yy, xx))
    return labels


def components(pixels: DataFrame) -> DataFrame:
    """tile_id, row, col, label of the pixels whose value is above 0; a group is one tile, which is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = label_components(_grid(pdf) > 0)
        rows, cols = np.nonzero(labels)
        return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "row": rows, "col": cols, "label": labels[rows, cols]})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    return pixels.select("tile_id", "row", "col", "value").groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, row int, col int, label int")


#: What a scene class is called where it spoils a pixel, the width of the speckle scale and the least quality of a radar tile.
SCENE_CONFOUNDS = {0: "nodata", 1: "saturated", 2: "dark", 3: "cloud_shadow", 8: "cloud_medium", 9: "cloud_high", 10: "cirrus", 11: "snow"}
SPECKLE_SCALE, LEAST_SPECKLE_QUALITY = 2.0, 0.25


def quality_masks(pixels: DataFrame, nodata: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Which pixels of each tile are usable, and what the tile's mask says.

    pixels: tile_id, row, col, band, value, sensor (one a tile). A pixel is valid if all of its
    bands are finite and they are not all `nodata`. Radar tiles (by sensor) are judged by the speckle of
    their first band (by name), optical ones by the band `scl` where they have one, else by clouds, from
    red, green and blue scaled to 0..1. A band that a pixel lacks has no say.
    Returns (tile_id, row, col, valid, usable) and (tile_id, modality, method, clear, valid_share,
    confounds, speckle, speckle_quality); the last two are null for optical tiles. All of it is three
    aggregates: by pixel, by tile, and the tile's largest value.
    """
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    top = F.when(fine & (F.col("band") != "scl"), F.col("value"))
    bands = F.min(F.when(F.col("band") != "scl", F.col("band")))
    tile = pixels.groupBy("tile_id").agg(F.max(top).alias("_top"), bands.alias("_first"), F.max("sensor").alias("sensor"), F.max((F.col("band") == "scl").cast("int")).alias("_scl"))
    by = F.when(F.col("_top") <= 1, num(1)).when(F.col("_top") <= 255, num(255)).otherwise(num(10000))
    name = F.lower(F.coalesce("sensor", F.lit("")))
    radar = name.contains("sar") | name.contains("sentinel-1") | name.contains("sentinel1")
    tile = tile.select("tile_id", by.alias("_by"), "_first", F.when(radar, "speckle").when(F.col("_scl") == 1, "scl").otherwise("brightness_saturation").alias("method"))
    of = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    rows = pixels.select("tile_id", "row", "col", "band", F.when(fine, F.col("value")).alias("value")).join(tile, "tile_id")
    rows = rows.groupBy("tile_id", "row", "col").agg(
        (F.bool_and(F.col("value").isNotNull()) & ~F.bool_and(F.coalesce(F.col("value") == nodata, F.lit(False)))).alias("valid"),
        F.max("method").alias("method"), *[(of(b) / F.max("_by")).alias(b) for b in ("red", "green", "blue")], of("scl").cast("int").alias("_class"),
        F.max(F.when(F.col("band") == F.col("_first"), F.abs("value"))).alias("_echo"),
    )
    cloud = F.coalesce(cloud_like(F.col("red"), F.col("green"), F.col("blue")), F.lit(False))
    method = F.col("method")
    echo = F.coalesce(F.col("_echo") > 0, F.lit(False))
    clear = F.when(method == "speckle", echo).when(method == "scl", F.coalesce(F.col("_class").isin(*CLEAR_CLASSES), F.lit(False))).otherwise(~cloud)
    rows = rows.withColumns({"usable": F.col("valid") & clear, "_cloud": cloud})
    named = F.create_map(*[F.lit(x) for pair in SCENE_CONFOUNDS.items() for x in pair])
    spread, mean = F.stddev_pop(F.when(echo, F.col("_echo"))), F.avg(F.when(echo, F.col("_echo")))
    said = rows.groupBy("tile_id").agg(
        F.max("method").alias("method"), fraction(F.col("usable")).alias("clear"), fraction(F.col("valid")).alias("valid_share"), F.max("_cloud").alias("_cloudy"),
        F.array_sort(F.collect_set(F.element_at(named, F.col("_class")))).alias("_classes"), (F.coalesce(spread, num(0)) / (F.coalesce(mean, num(0)) + 1e-6)).alias("_speckle"),
    )
    radar, quality = method == "speckle", clip(num(1) - F.col("_speckle") / SPECKLE_SCALE)
    none = F.array().cast("array<string>")
    confounds = F.when(radar, F.when(quality < LEAST_SPECKLE_QUALITY, F.array(F.lit("speckle"))).otherwise(none)).when(method == "scl", F.col("_classes")).when(F.col("_cloudy"), F.array(F.lit("cloud_haze"))).otherwise(none)
    said = said.select(
        "tile_id", F.when(radar, "sar").otherwise("optical").alias("modality"), "method", "clear", "valid_share", confounds.alias("confounds"),
        F.when(radar, F.round("_speckle", 5)).alias("speckle"), F.when(radar, F.round(quality, 5)).alias("speckle_quality"),
    )
    return rows.select("tile_id", "row", "col", "valid", "usable"), said


def sharpness(pixels: DataFrame) -> DataFrame:
    """tile_id, sharpness: variance of the second gradient over 0.02, at most 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _grid(pdf)
        gy, gx = np.gradient(g)
        second = np.gradient(gy)[0] + np.gradient(gx)[1]
        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "sharpness": [round(min(1.0, float(second.var()) / 0.02), 6)]})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    return pixels.select("tile_id", "row", "col", "value").groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, sharpness double")


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def resample(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """tile_id, row, col, value at the size asked for; a group is one tile's band."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = resized(_grid(pdf), height, width)
        r, c = np.indices(out.shape)
        return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "row": r.ravel(), "col": c.ravel(), "value": out.ravel()})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    return pixels.select("tile_id", "row", "col", "value").groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, row int, col int, value double")


def upsampled(patches: DataFrame) -> DataFrame:
    """pair_id, row, col, value: a map of patches (pair_id, pi, pj, d, _h, _w) at its image's size, bilinear; a group is one image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["pi"].max()) + 1, int(pdf["pj"].max()) + 1))
        grid[pdf["pi"], pdf["pj"]] = pdf["d"]
        out = resized(grid, int(pdf["_h"].iloc[0]), int(pdf["_w"].iloc[0]))
        r, c = np.indices(out.shape)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "row": r.ravel(), "col": c.ravel(), "value": out.ravel()})

    kind = patches.schema["pair_id"].dataType.simpleString()
    return patches.groupBy("pair_id").applyInPandas(run, f"pair_id {kind}, row int, col int, value double")


def best_shift(pairs: DataFrame, reach: int = 8, step: int = 2) -> DataFrame:
    """tile_id, dy, dx, correlation of the integer shift within the reach at which after fits before best, by a shifted join."""
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1, step)])
    size = pairs.groupBy("tile_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    left = pairs.select("tile_id", "row", "col", "before").join(size, "tile_id").withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    left = left.withColumn("_r", F.pmod(F.col("row") + F.col("dy"), F.col("_h"))).withColumn("_c", F.pmod(F.col("col") + F.col("dx"), F.col("_w")))
    right = pairs.select("tile_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "after")
    each = correlation(left.join(right, ["tile_id", "_r", "_c"]), ["tile_id", "dy", "dx"], "before", "after")
    best = each.groupBy("tile_id").agg(F.max_by(F.struct("dy", "dx", "correlation"), F.struct("correlation", -F.abs("dy") - F.abs("dx"), "dy", "dx")).alias("b"))
    return best.select("tile_id", "b.dy", "b.dx", "b.correlation")
