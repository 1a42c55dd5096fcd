"""Change detection: observation stacks, bi-temporal pairs and dense series for many areas at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt import lineage
from skyquilt.functions import scalar as S
from skyquilt.operators import filters, images, raster, series, spatial

#: Reach of the candidate search in degrees and of its second try, and the slack of the nearest cell.
REACH, SECOND_REACH, CELL_SLACK = 0.08, 0.15, 0.005


def cut(df: DataFrame) -> DataFrame:
    """`lineage.cut` for pixels and what grows with them: files are far smaller than their rows, so no side is broadcast for its files' size."""
    return lineage.cut(df).hint("merge")


def candidates(areas: DataFrame, tiles: DataFrame, reach: float = REACH, least_quality: float = 0.4, start: str | None = None, end: str | None = None) -> DataFrame:
    """The observation stack of each area (area_id, lon, lat): area_id, the tile's columns and index.

    Usable tiles in reach; if two or more lie near the nearest cell only those; the best by
    quality for each day and modality; of long stacks the first four and last eight.
    """
    usable = tiles.where(filters.by_dates(F.col("ts"), start, end) & filters.usable(F.col("quality"), F.col("cloud"), least_quality))
    near = spatial.band_join(areas.select("area_id", "lon", "lat"), usable, reach)
    near = near.select("area_id", F.sqrt(F.pow(F.col("lon") - F.col("lon_2"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("lat_2"), F.lit(2.0))).alias("distance"), *[F.col(f"{c}_2").alias(c) for c in tiles.columns])
    whole = Window.partitionBy("area_id")
    near = near.withColumn("_cell", F.col("distance") <= F.min("distance").over(whole) + CELL_SLACK).withColumn("_n", F.sum(F.col("_cell").cast("int")).over(whole))
    near = near.where(F.col("_cell") | (F.col("_n") < 2)).drop("_cell", "_n")
    near = near.withColumn("day", F.to_date("ts")).withColumn("mode", F.when(F.lower("sensor").contains("sar"), "sar").otherwise("optical"))
    best = series.best_per(near, ["area_id", "day", "mode"], [F.coalesce("quality", F.lit(0.5)).desc(), F.col("ts"), F.col("tile_id")])
    return series.numbered(series.head_and_tail(best, ["area_id"], ["ts", "tile_id"]), ["area_id"], ["ts", "tile_id"])


def same_cell(stack: DataFrame, reference: str = "reference_tile_id") -> DataFrame:
    """Where two or more rows of an area share the reference tile's window (row_off, col_off), only those."""
    ref = stack.where(F.col("tile_id") == F.col(reference)).select("area_id", F.col("row_off").alias("_r"), F.col("col_off").alias("_c"))
    marked = stack.join(ref, "area_id", "left").withColumn("_same", F.coalesce((F.col("row_off") == F.col("_r")) & (F.col("col_off") == F.col("_c")), F.lit(False)))
    marked = marked.withColumn("_n", F.sum(F.col("_same").cast("int")).over(Window.partitionBy("area_id")))
    return marked.where(F.col("_same") | (F.col("_n") < 2)).drop("_r", "_c", "_same", "_n")


def acquisitions(areas: DataFrame, tiles: DataFrame, reach: float = REACH) -> DataFrame:
    """For each area, day and sensor the nearest tile, numbered by date."""
    near = spatial.band_join(areas.select("area_id", "lon", "lat"), tiles.where("ts is not null"), reach)
    d = F.sqrt(F.pow(F.col("lon") - F.col("lon_2"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("lat_2"), F.lit(2.0)))
    near = near.select("area_id", d.alias("distance"), *[F.col(f"{c}_2").alias(c) for c in tiles.columns])
    best = series.best_per(near, ["area_id", F.to_date("ts"), "sensor"], [F.col("distance"), F.col("tile_id")])
    return series.numbered(best, ["area_id"], ["ts", "tile_id"])


def pairs(stack: DataFrame, reference: DataFrame) -> DataFrame:
    """area_id, before_tile_id, after_tile_id: earliest before the reference and it; else it and the last after; else first and last.

    reference: area_id, ref_tile_id, ref_ts; areas without one pair their first and last.
    """
    rows = stack.join(reference, "area_id", "left")
    at = F.struct("ts", "tile_id")
    per = rows.groupBy("area_id").agg(
        F.min_by("tile_id", F.when(F.col("ts") < F.col("ref_ts"), at)).alias("_before"), F.max_by("tile_id", F.when(F.col("ts") > F.col("ref_ts"), at)).alias("_after"),
        F.min_by("tile_id", at).alias("_first"), F.max_by("tile_id", at).alias("_last"), F.first("ref_tile_id").alias("_ref"), F.count("*").alias("n"),
    ).where("n >= 2")
    before = F.when(F.col("_before").isNotNull(), F.col("_before")).when(F.col("_after").isNotNull(), F.col("_ref")).otherwise(F.col("_first"))
    after = F.when(F.col("_before").isNotNull(), F.col("_ref")).when(F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_last"))
    return per.select("area_id", before.alias("before_tile_id"), after.alias("after_tile_id"))


def earliest_change(observations: DataFrame, threshold: float = 0.18) -> DataFrame:
    """area_id, earliest: the first date whose distance is over the threshold, else the after date (after_ts)."""
    per = observations.groupBy("area_id").agg(F.min(F.when(F.col("distance") > threshold, F.col("ts"))).alias("_hit"), F.max("after_ts").alias("_after"))
    return per.select("area_id", F.coalesce("_hit", "_after").alias("earliest"))


def dominant(regions: DataFrame, key: list[str], kind: str, default: str = "unclassified") -> DataFrame:
    """The kind with the most area; ties to the one with the first region."""
    sums = regions.groupBy(*key, kind).agg(F.sum("area").alias("_area"), F.min("region_id").alias("_first"))
    best = sums.groupBy(*key).agg(F.max_by(kind, F.struct("_area", -F.col("_first"))).alias(f"dominant_{kind}"))
    return best.withColumn(f"dominant_{kind}", F.coalesce(f"dominant_{kind}", F.lit(default)))


def regions(deltas: DataFrame, mask: DataFrame, least: int = 9) -> DataFrame:
    """Typed regions of each tile: mask (tile_id, row, col, value) labelled, measured on deltas (indices before, after and their difference)."""
    return labelled_regions(raster.components(mask).join(deltas, ["tile_id", "row", "col"]), least)


def labelled_regions(pixels: DataFrame, least: int = 9) -> DataFrame:
    """Typed regions of each tile, of labelled pixels (tile_id, label, row, col and the indices before, after and their difference)."""
    stats = raster.region_stats(pixels, ["tile_id", "label"], least)
    means = pixels.groupBy("tile_id", "label").agg(*[F.avg(c).alias(f"m_{c}") for c in ("before_ndbi", "after_ndbi", "after_ndwi", "after_ndvi")])
    rows = stats.join(means.hint("merge"), ["tile_id", "label"])
    kind = S.region_type(F.col("elongation"), F.col("aspect"), F.col("solidity"), F.col("d_ndvi"), F.col("d_ndwi"), F.col("d_ndbi"), F.col("m_before_ndbi"), F.col("m_after_ndbi"), F.col("m_after_ndwi"), F.col("m_after_ndvi"))
    return rows.withColumn("_k", kind).select("tile_id", "label", "area", "elongation", "aspect", "d_ndvi", "d_ndwi", "d_ndbi", "_k.change_type", "_k.dynamics", "_k.confidence")


def observation_distances(pair_rows: DataFrame, stack: DataFrame, pixels: DataFrame) -> DataFrame:
    """area_id, ts, tile_id, distance: how far each later pass of a stack (area_id, tile_id, ts) is from the area's before image, patch by patch.

    The first pass of an area is what the others are dated from and has no row; a pass without a patch in common has none either.
    """
    numbered = series.numbered(stack.select("area_id", "tile_id", "ts"), ["area_id"], ["ts", "tile_id"])
    first = numbered.groupBy("area_id").agg(F.min("index").alias("_first"))
    later = numbered.join(first, "area_id").where("index > _first").select("area_id", "tile_id", "ts")
    wanted = later.select("tile_id").unionByName(pair_rows.select(F.col("before_tile_id").alias("tile_id"))).distinct()
    vectors = cut(images.patch_vectors(images.packed(pixels.join(wanted, "tile_id", "left_semi"))))
    base = pair_rows.select("area_id", F.col("before_tile_id").alias("tile_id")).join(vectors, "tile_id").select("area_id", "pi", "pj", F.col("_x").alias("_y"), F.col("_x_bands").alias("_y_bands"))
    met = later.join(vectors, "tile_id").join(base, ["area_id", "pi", "pj"]).where(F.col("_x_bands") == F.col("_y_bands"))
    return met.groupBy("area_id", "ts", "tile_id").agg(F.avg(raster.feature_difference(F.col("_y"), F.col("_x"))).alias("distance"))


def known_indices(grid: DataFrame) -> DataFrame:
    """Pixels of `images.pixels_of` with known, whether red, green and nir are there, and then the indices before and after, and their differences; else null."""
    grid = grid.withColumn("known", F.col("before_red").isNotNull() & F.col("before_green").isNotNull() & F.col("before_nir").isNotNull())
    for side in ("before", "after"):
        with_swir = raster.indices({b: F.col(f"{side}_{b}") for b in ("green", "red", "nir", "swir1")})
        without = raster.indices({b: F.col(f"{side}_{b}") for b in ("green", "red", "nir")})
        grid = grid.withColumns({f"{side}_{n}": F.when(F.col("known"), F.coalesce(with_swir[n], without[n])) for n in with_swir})
    return grid.withColumns({f"d_{n}": F.col(f"after_{n}") - F.col(f"before_{n}") for n in ("ndvi", "ndwi", "ndbi")})


#: Share of the before image's pixels that must be compared for a score.
LEAST_COMPARED = 0.1


def bitemporal(pair_rows: DataFrame, pixels: DataFrame, tiles: DataFrame, stack: DataFrame | None = None, prob_threshold: float = 0.5, map_threshold: float = 0.20, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Change between two dates for many areas: one row per pair, and its typed regions.

    pair_rows: area_id, before_tile_id, after_tile_id; pixels: tile_id, row, col, band,
    value in 0..1; tiles: tile_id, ts, quality, and resolution_m if known; stack: area_id,
    tile_id, ts of the areas' other passes, if there are any: their distances from the before image
    are the area's series, and `earliest` is the first date over the threshold, the after date if none is.
    `compared` is the share of the before image's pixels that were compared; under LEAST_COMPARED there is no score. Registration, radiometric matching, patch
    distances, masks, quality, false-alarm penalties, regions and the check list, in that order.
    """
    pair_rows = cut(pair_rows)
    observed = cut(observation_distances(pair_rows, stack, pixels)) if stack is not None else None
    ends = images.packed(pixels.join(pair_rows.select(F.explode(F.array("before_tile_id", "after_tile_id")).alias("tile_id")).distinct(), "tile_id", "left_semi"))
    of = lambda column: pair_rows.select(F.col("area_id").alias("pair_id"), F.col(column).alias("tile_id")).join(ends, "tile_id").drop("tile_id")
    pairs_met = cut(images.compared(of("before_tile_id"), of("after_tile_id"), ["pair_id"], map_threshold))
    grid = known_indices(images.pixels_of(pairs_met, ["pair_id"]))

    def quality(side: str, tag: str) -> list[Column]:
        red, green, blue = (F.when(F.col("met") > 0, F.col(f"{side}_{b}")) for b in ("red", "green", "blue"))
        known = red.isNotNull() & green.isNotNull() & blue.isNotNull()
        seen = lambda c: F.when(F.col("met") > 0, c)
        cloud = F.coalesce(raster.cloud_like(red, green, blue), F.lit(False))
        return [raster.fraction(seen(known & (red + green + blue > 0))).alias(f"valid_{tag}"), raster.fraction(seen(cloud)).alias(f"cloud_{tag}"), F.avg((red + green + blue) / 3).alias(f"mean_{tag}")]

    means = grid.groupBy("pair_id").agg(*[F.round(F.avg(f"d_{n}"), 4).alias(f"d_{n}") for n in ("ndvi", "ndwi", "ndbi")], *quality("before", "b"), *quality("after", "a"), F.sum("met").alias("_met"))
    # without the pixels
    said = pairs_met.select("pair_id", "raw", "changed", "inliers", "correlation_before", "correlation", "is_aligned", "dy", "dx", "_all")
    out = pair_rows.withColumnRenamed("area_id", "pair_id")
    for side, column in (("b", "before_tile_id"), ("a", "after_tile_id")):
        out = out.join(tiles.select(F.col("tile_id").alias(column), F.col("ts").alias(f"_ts_{side}"), S.or_default(F.col("quality"), 0.5).alias(f"_q_{side}"), (F.col("resolution_m") if "resolution_m" in tiles.columns else S.num(10)).alias(f"_res_{side}")), column, "left")
    for part in (said, means):
        out = out.join(part.hint("merge"), "pair_id", "left")
    if observed is not None:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "tile_id", "distance"))), lambda x: x["distance"])
        out = out.join(observed.groupBy(F.col("area_id").alias("pair_id")).agg(listed.alias("scores")), "pair_id", "left")
        dated = observed.join(out.select(F.col("pair_id").alias("area_id"), F.col("_ts_a").alias("after_ts")), "area_id")
        out = out.join(earliest_change(dated, prob_threshold).withColumnRenamed("area_id", "pair_id"), "pair_id", "left")
        out = out.withColumn("earliest", F.least(F.coalesce("earliest", "_ts_a"), "_ts_a"))
    else:
        out = out.withColumn("scores", F.lit(None).cast("array<double>")).withColumn("earliest", F.col("_ts_a"))
    out = out.withColumn("compared", F.coalesce(F.round(F.coalesce("_met", F.lit(0)) / F.col("_all"), 4), S.num(0)))
    radiometric = F.abs(F.col("mean_b") - F.col("mean_a"))
    judged = S.suppressed(F.coalesce("raw", S.num(0)), F.col("cloud_b"), F.col("cloud_a"), F.col("valid_b"), F.col("valid_a"), F.col("_q_b"), F.col("_q_a"), F.col("correlation"), radiometric, F.col("scores"), threshold=prob_threshold)
    out = out.withColumn("_s", judged).withColumn("radiometric", radiometric)
    found = cut(labelled_regions(grid.where("label > 0 and known").withColumnRenamed("pair_id", "tile_id"), least).withColumnsRenamed({"tile_id": "pair_id", "label": "region_id"}))
    for kind, none in (("change_type", "no_significant_change"), ("dynamics", "stable")):
        out = out.join(dominant(found, ["pair_id"], kind), "pair_id", "left").withColumn(f"dominant_{kind}", F.coalesce(f"dominant_{kind}", F.lit(none)))
    over = F.size(F.filter(F.coalesce("scores", F.array().cast("array<double>")), lambda v: v > prob_threshold))
    out = evidence(out.withColumn("persistent", over).withColumn("observed", F.coalesce(F.size("scores"), F.lit(0))).withColumn("cloud", F.greatest("cloud_b", "cloud_a")))
    rows = out.select(
        F.col("pair_id").alias("area_id"), "before_tile_id", "after_tile_id", F.when(F.col("compared") >= LEAST_COMPARED, F.col("_s.change_score")).alias("change_score"), "_s.quality_score", "_s.confidence", "_s.confounds", "dominant_change_type", "dominant_dynamics", S.area_hectares(F.coalesce("changed", S.num(0)), F.col("_res_b")).alias("area_ha"),
        "d_ndvi", "d_ndwi", "d_ndbi", "dy", "dx", "inliers", "correlation", "is_aligned", F.round("radiometric", 4).alias("radiometric"), "checks", "passed", "compared", "earliest",
    )
    return rows, found.withColumnRenamed("pair_id", "area_id")


def signals(stack: DataFrame, pixels: DataFrame, baseline: int = 3) -> DataFrame:
    """area_id, ts, tile_id, mode, score, quality, cloud, valid_share, is_aligned, d_ndvi, d_ndwi, d_ndbi: each pass of a stack against its area's baseline.

    stack: area_id, tile_id, ts, mode, quality, cloud, valid_share. The baseline of a modality
    is the median of its usable passes among the first `baseline` usable ones of the area, or
    its first usable one. Baseline passes have signal 0; what cannot be aligned is not usable.
    """
    usable = filters.dense_usable(F.col("quality"), F.col("cloud"), F.col("valid_share"))
    rows = cut(stack.withColumn("usable", usable))
    by_area, by_mode = Window.partitionBy("area_id").orderBy(~F.col("usable"), "ts", "tile_id"), Window.partitionBy("area_id", "mode").orderBy(~F.col("usable"), "ts", "tile_id")
    ranks = rows.withColumn("_n", F.row_number().over(by_area)).withColumn("_m", F.row_number().over(by_mode))
    first = F.col("usable") & (F.col("_n") <= baseline)
    some = F.max(first.cast("int")).over(Window.partitionBy("area_id", "mode")) == 1
    ranks = cut(ranks.withColumn("is_baseline", first | (F.col("usable") & ~some & (F.col("_m") == 1))).drop("_n", "_m"))
    key = ["area_id", "mode"]
    of = lambda part: images.packed(pixels.join(part.select("tile_id").distinct(), "tile_id", "left_semi")).join(part, "tile_id")
    base = images.medians(of(ranks.where("is_baseline").select("tile_id", *key)), key)
    later = of(ranks.where("not is_baseline").select("tile_id", *key)).withColumnRenamed("tile_id", "pair_id")
    grid = known_indices(images.pixels_of(images.compared(base, later, key), ["pair_id", "is_aligned", "raw", "step", "spread"]))
    deltas = grid.groupBy("pair_id").agg(
        F.first("is_aligned").alias("is_aligned"), F.first("raw").alias("feature"), F.least(S.num(1), F.first("step") / F.greatest(F.first("spread"), S.num(1e-6))).alias("pixel"),
        *[F.avg(f"d_{n}").alias(f"d_{n}") for n in ("ndvi", "ndwi", "ndbi")],
    )
    out = ranks.join(deltas.withColumnRenamed("pair_id", "tile_id").hint("merge"), "tile_id", "left")
    zero = lambda c: F.coalesce(F.col(c), S.num(0))
    spectral = F.least(S.num(1), (F.abs(zero("d_ndvi")) + F.abs(zero("d_ndwi")) + F.abs(zero("d_ndbi"))) * S.num(2 / 3))
    score = F.when(F.col("is_baseline"), S.num(0)).otherwise(S.dense_signal(F.col("mode"), zero("feature"), spectral, zero("pixel")))
    lost = F.coalesce(~F.col("is_aligned"), F.lit(False))
    return out.select("area_id", "ts", "tile_id", "mode", score.alias("score"), F.when(lost, S.num(0)).otherwise(F.col("quality")).alias("quality"), "cloud", "valid_share", "is_baseline", "is_aligned", "d_ndvi", "d_ndwi", "d_ndbi")


def dense(signals: DataFrame, baseline: int = 3, persistence: int = 2, threshold: float = 0.18) -> DataFrame:
    """One row per area: strategy and, for dense ones, the change point.

    signals: area_id, ts, tile_id, score, quality, cloud, valid_share. Areas with baseline +
    persistence usable passes are dense; others with two are bitemporal; the rest are listed.
    All areas run in one plan.
    """
    rows = signals.withColumn("valid", filters.dense_usable(F.col("quality"), F.col("cloud"), F.col("valid_share")))
    counts = rows.groupBy("area_id").agg(F.count_if("valid").alias("usable"), F.count("*").alias("n"))
    strategy = F.when(F.col("usable") >= baseline + persistence, "dense").when(F.col("n") >= 2, "bitemporal").otherwise("listing")
    chosen = counts.withColumn("strategy", strategy)
    points = series.change_points(rows.join(chosen.where("strategy = 'dense'").select("area_id"), "area_id", "left_semi"), ["area_id"], "ts", baseline, persistence, threshold)
    return chosen.join(points, "area_id", "left")


def analyse(stack: DataFrame, pixels: DataFrame, baseline: int = 3, persistence: int = 2, threshold: float = 0.18) -> tuple[DataFrame, DataFrame]:
    """Dense change detection of stacks (as `signals` takes them): one row per area with its strategy and change point, and the two-date analysis of the areas that lack the passes."""
    rows = cut(signals(stack, pixels, baseline))
    chosen = cut(dense(rows, baseline, persistence, threshold))
    short = cut(stack.join(chosen.where("strategy = 'bitemporal'").select("area_id"), "area_id", "left_semi"))
    at = F.struct("ts", "tile_id")
    ends = short.groupBy("area_id").agg(F.min_by("tile_id", at).alias("before_tile_id"), F.max_by("tile_id", at).alias("after_tile_id"))
    fallback, _ = bitemporal(ends, pixels, stack.select("tile_id", "ts", "quality").dropDuplicates(["tile_id"]), short)
    return chosen, fallback


def evidence(rows: DataFrame) -> DataFrame:
    """Add checks, an array of (item, status), and passed. rows: d_ndvi, d_ndbi, d_ndwi, observed (other dates), correlation, cloud (the worse of both)."""

    def item(name: str, ok: Column, otherwise: str = "info") -> Column:
        return F.struct(F.lit(name).alias("item"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(otherwise).alias("status"))

    checks = F.array(
        item("built_up", F.abs("d_ndbi") > 0.05), item("vegetation", F.abs("d_ndvi") > 0.05), item("water", F.abs("d_ndwi") > 0.05),
        item("persistence", F.col("observed") >= 2), item("registration", F.col("correlation") >= 0.7, "fail"), item("clouds", F.col("cloud") < 0.20, "fail"),
    )
    return rows.withColumn("checks", checks).withColumn("passed", F.size(F.filter("checks", lambda c: c["status"] == "pass")))
