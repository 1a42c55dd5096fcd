"""Grounded answers: evidence by keyword routes, and a deterministic summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators import series, spatial

#: Routes and the texts that choose them, wherever they stand in a message.
ROUTES = {
    "change": ("change", "confidence", "anomaly", "compare", "before", "after", "area", "delta"),
    "tile": ("tile", "sensor", "spectral", "ndvi", "ndwi", "ndbi", "quality", "cloud", "resolution", "provenance"),
    "cluster": ("neighbor", "neighbour", "cluster", "similar", "nearby"),
    "review": ("review", "audit", "feedback", "verdict", "confirm", "reject", "analyst"),
    "catalog": ("catalog", "system", "inventory", "indexed", "total scenes", "total tiles"),
    "search": ("search", "find", "look for", "show me"),
}
#: The sensors that the catalogue speaks of, and the answer without evidence.
SENSORS = "Sentinel-2 L2A, Sentinel-1 GRD, Landsat-8/9, ISRO Resourcesat"
NOTHING = "Terra is ready. Ask any question regarding sensor provenance, spectral indices (NDVI/NDWI/NDBI), detected changes, or catalog inventory."
#: Half width in degrees of the box of a tile's neighbours, and how many of them are listed.
NEIGHBOURS, LISTED = 0.2, 4


def routes(message: Column) -> Column:
    """The routes that a message chooses."""
    low = F.lower(F.trim(message))
    return F.filter(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in ROUTES.items()]), lambda r: r.isNotNull())


def context(turns: DataFrame, memory: int = 8) -> DataFrame:
    """The last turns of each conversation."""
    return series.last_turns(turns, "conv_id", "turn", memory)


def cited(evidence: DataFrame) -> DataFrame:
    """Each (type, id, field) once."""
    return evidence.dropDuplicates(["type", "id", "field"])


def band_word(value: Column, high: float, low: float, words: tuple[str, str, str]) -> Column:
    return F.when(value > high, words[0]).when(value > low, words[1]).otherwise(words[2])


def gathered(messages: DataFrame, results: DataFrame, tiles: DataFrame, scenes: DataFrame, feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add to messages (text, tile_id, change_id) the evidence that their routes ask for: structs change, tile, cluster, review and catalog, null if not asked for or not found.

    A message without a target speaks of the newest change, or of the tile of its change,
    or of the newest tile. All messages are answered in one plan.
    """
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("N/A"))
    rows = messages.withColumn("_r", routes(F.col("text"))).withColumn("_cid", F.col("change_id")).withColumn("_tid", F.col("tile_id"))
    asks = lambda name: F.array_contains("_r", name)
    newest = results.orderBy(F.col("created_at").desc_nulls_last(), F.col("change_id").desc()).limit(1).select("change_id").scalar()
    c = results.select("change_id", "before_tile_id", "after_tile_id", "confidence", *[x if x in results.columns else F.lit(None).cast("double").alias(x) for x in ("change_area_m2", "quality_score")], *[x if x in results.columns else F.array(F.lit("Multi-spectral anomaly detected")).alias(x) for x in ("reasons",)])
    for side in ("before", "after"):
        t = tiles.select(F.col("tile_id").alias(f"_{side}"), F.col("ts").alias(f"_{side}_ts"), F.coalesce("cloud", F.lit(0.0)).alias(f"_{side}_cloud"))
        c = c.join(t, F.col(f"{side}_tile_id") == F.col(f"_{side}"), "left")
    shadow = F.coalesce(F.abs(F.col("_after_cloud") - F.col("_before_cloud")), F.lit(0.0)) > 0.15
    good = F.coalesce(F.nullif("quality_score", F.lit(0.0)), F.lit(0.8)) > 0.75
    change = F.struct(
        "change_id", "before_tile_id", "confidence", "change_area_m2", "reasons", day("_before_ts").alias("before_date"), day("_after_ts").alias("after_date"),
        F.when(good & ~shadow, "LOW").otherwise("MEDIUM").alias("false_alarm_risk"), F.when(shadow, "HIGH").otherwise("LOW").alias("cloud_shadow_risk"),
    )
    rows = rows.withColumn("_want", F.when(F.col("_cid").isNotNull() | asks("change"), F.coalesce("_cid", newest)))
    rows = rows.join(c.select(F.col("change_id").alias("_found"), change.alias("change")), F.col("_want") == F.col("_found"), "left").drop("_found", "_want")

    latest = tiles.orderBy(F.col("ts").desc_nulls_last(), F.col("tile_id").desc()).limit(1).select("tile_id").scalar()
    known = [x if x in scenes.columns else F.lit(None).cast("string").alias(x) for x in ("source_portal",)]
    t = tiles.select("tile_id", "scene_id", "ts", "sensor", "cloud", "quality", "ndvi", "ndwi", "ndbi", "lon", "lat", "resolution_m" if "resolution_m" in tiles.columns else F.lit(10.0).alias("resolution_m"))
    t = t.join(scenes.select("scene_id", *known), "scene_id", "left")
    index = lambda c: F.coalesce(c, F.lit(0.0))
    some = lambda c, default: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))
    tile = F.struct(
        "tile_id", "lon", "lat", F.coalesce("sensor", F.lit("Sentinel-2")).alias("sensor"), day("ts").alias("acquisition_date"), some("resolution_m", 10.0).alias("resolution_m"), some("quality", 0.85).alias("quality_score"), index("cloud").alias("cloud_fraction"),
        *[F.round(index(x), 3).alias(f"{x}_mean") for x in ("ndvi", "ndwi", "ndbi")],
        band_word(index("ndvi"), 0.4, 0.15, ("Dense Healthy Vegetation", "Moderate Canopy / Shrub", "Low Vegetation / Barren")).alias("vegetation_status"),
        band_word(index("ndwi"), 0.1, -0.1, ("Open Water Surface", "Moist Soil / Wetland", "Dry Surface")).alias("water_status"),
        band_word(index("ndbi"), 0.0, -0.15, ("High-Density Built Structure", "Urban / Semi-Urban", "Non-Urban")).alias("built_status"),
        F.coalesce("source_portal", F.lit("Copernicus Open Access")).alias("source_portal"),
    )
    rows = rows.withColumn("_want", F.when(F.col("_tid").isNotNull() | asks("tile"), F.coalesce("_tid", "change.before_tile_id", latest)))
    rows = rows.join(t.select(F.col("tile_id").alias("_found"), tile.alias("tile")), F.col("_want") == F.col("_found"), "left").drop("_found", "_want")

    rows = rows.withColumn("_anchor", F.when(asks("cluster"), F.coalesce("_tid", "tile.tile_id")))
    anchors = rows.select(F.col("_anchor").alias("tile_id")).distinct().join(tiles.select("tile_id", "lon", "lat"), "tile_id")
    near = spatial.band_join(anchors, tiles.select("tile_id", "lon", "lat"), NEIGHBOURS).where("tile_id <> tile_id_2")
    listed = near.withColumn("_n", F.row_number().over(Window.partitionBy("tile_id").orderBy("tile_id_2"))).where(F.col("_n") <= LISTED)
    first = listed.groupBy(F.col("tile_id").alias("_at")).agg(F.array_sort(F.collect_list("tile_id_2")).alias("neighbor_ids"))
    rows = rows.join(first, F.col("_anchor") == F.col("_at"), "left")
    rows = rows.withColumn("cluster", F.when(F.col("_anchor").isNotNull(), F.struct(F.coalesce(F.size("neighbor_ids"), F.lit(0)).alias("neighbors_count"), F.col("neighbor_ids")))).drop("_at", "neighbor_ids", "_anchor")

    said = feedback.groupBy(F.col("target_id").alias("_target")).agg(F.count("*").alias("total_reviews"), F.max_by(F.struct("verdict", *[x if x in feedback.columns else F.lit(None).cast("string").alias(x) for x in ("analyst", "note")]), F.struct("created_at", "feedback_id")).alias("last"))
    rows = rows.join(said, F.coalesce("_cid", "_tid") == F.col("_target"), "left")
    review = F.struct(F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"), F.col("last.verdict").alias("latest_verdict"), F.coalesce(F.nullif("last.analyst", F.lit("")), F.lit("Human-in-the-Loop Analyst")).alias("analyst"), F.col("last.note").alias("note"))
    rows = rows.withColumn("review", F.when(asks("review") & F.coalesce("_cid", "_tid").isNotNull(), review)).drop("_target", "total_reviews", "last")

    total = lambda t: t.agg(F.count("*")).scalar()
    catalog = F.struct(total(scenes).alias("total_scenes"), total(tiles).alias("total_tiles"), total(vectors).alias("vector_embeddings"))
    return rows.withColumn("catalog", F.when(asks("catalog"), catalog)).drop("_r", "_cid", "_tid")


def summary(rows: DataFrame) -> DataFrame:
    """Add summary: the sentences on each piece of evidence of `gathered`, in its order, and on search (struct query, matches: array of (tile_id, score)) if there is that column."""
    share = lambda c: F.concat(F.format_string("%.1f", F.round(F.col(c) * 100, 1)), F.lit("%"))
    sure = F.when(F.col("change.confidence").isNull(), "None%").when(F.col("change.confidence") <= 1, share("change.confidence")).otherwise(F.concat(F.col("change.confidence").cast("string"), F.lit("%")))
    area = F.when(F.col("change.change_area_m2").isNull(), "Calculated").otherwise(F.concat(F.format_number("change.change_area_m2", 0), F.lit(" m²")))
    text = lambda c: F.col(c).cast("string")
    parts = [
        F.when(F.col("change").isNotNull(), F.concat(
            F.lit("The detected change has a "), sure, F.lit(" confidence score with an estimated footprint of "), area, F.lit(". Baseline observation: "), F.col("change.before_date"), F.lit(" vs Target observation: "), F.col("change.after_date"),
            F.lit(". False alarm risk is "), F.col("change.false_alarm_risk"), F.lit(" (Cloud Shadow Risk: "), F.col("change.cloud_shadow_risk"), F.lit("). Factors: "), F.array_join(F.slice("change.reasons", 1, 2), "; "), F.lit("."),
        )),
        F.when(F.col("tile").isNotNull(), F.concat(
            F.lit("Tile "), text("tile.tile_id"), F.lit(" was acquired on "), F.col("tile.acquisition_date"), F.lit(" by "), F.col("tile.sensor"), F.lit(" at "), text("tile.resolution_m"), F.lit("m GSD. Quality score: "), share("tile.quality_score"), F.lit(", cloud cover: "), share("tile.cloud_fraction"),
            *[x for n, s in (("ndvi", "vegetation"), ("ndwi", "water"), ("ndbi", "built")) for x in (F.lit({"ndvi": ". Spectral indices: NDVI ", "ndwi": ", NDWI ", "ndbi": ", NDBI "}[n]), text(f"tile.{n}_mean"), F.lit(" ("), F.col(f"tile.{s}_status"), F.lit(")"))],
            F.lit(". Source: "), F.col("tile.source_portal"), F.lit("."),
        )),
        F.when(F.col("cluster").isNotNull(), F.concat(F.lit("Discovered "), text("cluster.neighbors_count"), F.lit(" similar cluster neighbors in localized geographic proximity."))),
        F.when(F.col("review.total_reviews") > 0, F.concat(
            F.lit("Analyst audit trail: latest verdict is "), F.upper("review.latest_verdict"), F.lit(" by "), F.col("review.analyst"), F.lit("."), F.when(F.coalesce("review.note", F.lit("")) != "", F.concat(F.lit(" Note: '"), F.col("review.note"), F.lit("'"))).otherwise(""),
        )).when(F.col("review").isNotNull(), "This target is currently pending human analyst verification."),
        F.when(F.col("catalog").isNotNull(), F.concat(
            F.lit("Catalog inventory: "), text("catalog.total_scenes"), F.lit(" scenes, "), F.format_number("catalog.total_tiles", 0), F.lit(" tiles, "), F.format_number("catalog.vector_embeddings", 0), F.lit(f" vector points across active modalities ({SENSORS})."),
        )),
    ]
    if "search" in rows.columns:
        top = F.array_join(F.transform("search.matches", lambda m: F.concat(F.substring(m["tile_id"].cast("string"), 1, 8), F.lit(" ("), m["score"].cast("string"), F.lit(")"))), ", ")
        found = F.concat(F.lit("Search for '"), F.col("search.query"), F.lit("' returned "), F.size("search.matches").cast("string"), F.lit(" matching tiles. Top matches: "), top, F.lit("."))
        parts.append(F.when(F.size("search.matches") > 0, found).when(F.col("search").isNotNull(), F.concat(F.lit("No catalog matches found for '"), F.col("search.query"), F.lit("'."))))
    said = F.concat_ws(" ", *parts)
    return rows.withColumn("summary", F.when(said == "", NOTHING).otherwise(said))
