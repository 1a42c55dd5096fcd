"""Counts, versions and exports of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def versions(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("versions"))


def stale(rows: DataFrame, column: str, current: str) -> DataFrame:
    """Whether any stored version is not the current one."""
    return rows.agg((F.count_if(F.col(column) != current) > 0).alias("stale"), F.count_if(F.col(column) == current).alias("current"))


def tile_counts(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    n = tiles.groupBy("scene_id").agg(F.count("tile_id").alias("tile_count"))
    return scenes.join(n, "scene_id", "left").withColumn("tile_count", F.coalesce("tile_count", F.lit(0)).cast("long"))


def _or_null(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that `rows` has with a value."""
    there = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def geojson(rows: DataFrame) -> DataFrame:
    """tile_id, feature: one GeoJSON point a row, with what the row has of the properties; missing or infinite coordinates are an error."""
    finite = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    refused = F.raise_error(F.concat(F.lit("coordinates are unavailable: "), F.coalesce(F.col("tile_id").cast("string"), F.lit("null"))))
    properties = F.struct(
        F.col("tile_id").alias("id"), _or_null(rows, "similarity", "confidence").alias("similarity"), _or_null(rows, "sensor").alias("sensor"), _or_null(rows, "acquisition_date", "ts").alias("acquisition_date"), _or_null(rows, "change_type").alias("change_type"),
        _or_null(rows, "cloud").alias("cloud_fraction"), *[_or_null(rows, n).alias(n) for n in ("source_portal", "underlying_dataset", "license", "provenance")],
    )
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    text = F.to_json(feature, {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return rows.select("tile_id", F.when(finite, text).otherwise(refused.cast("string")).alias("feature"))


def percent(value: Column) -> Column:
    """x.x% or N/A."""
    return F.when(value.isNull(), "N/A").otherwise(F.concat(F.format_string("%.1f", F.round(value * 100, 1)), F.lit("%")))


#: The columns of the tabular export.
CSV_COLUMNS = ("Target ID", "Longitude", "Latitude", "Sensor", "Acquisition Date", "Score / Confidence", "Change Type", "Cloud Cover %", "Source Portal", "Dataset", "License")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The tabular export, all as text; what is missing is N/A, or empty in the columns on the source."""
    text = lambda c, none="N/A": F.coalesce(c.cast("string"), F.lit(none))
    cells = [
        text(_or_null(rows, "tile_id")), text(_or_null(rows, "lon")), text(_or_null(rows, "lat")), text(_or_null(rows, "sensor")), text(F.date_format(_or_null(rows, "ts"), "yyyy-MM-dd")), percent(_or_null(rows, "final_score", "confidence")),
        text(_or_null(rows, "change_type")), percent(_or_null(rows, "cloud")), text(_or_null(rows, "source_portal"), ""), text(_or_null(rows, "underlying_dataset"), ""), text(_or_null(rows, "license"), ""),
    ]
    return rows.select(*[c.alias(n) for c, n in zip(cells, CSV_COLUMNS)])


def manifest(scenes: DataFrame) -> DataFrame:
    return scenes.select(F.to_json(F.struct(*scenes.columns)).alias("line"))


def evidence_package(rows: DataFrame) -> DataFrame:
    """body and sha256: each row as JSON with the digest of its text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body")).withColumn("sha256", F.sha2("body", 256))


def cache_stats(files: DataFrame) -> DataFrame:
    """Per zoom: tiles and megabytes of a tile cache (path z/x/y.png, length)."""
    zoom = F.regexp_extract("path", r"(\d+)/\d+/\d+\.png$", 1)
    return files.where(zoom != "").groupBy(zoom.cast("int").alias("zoom")).agg(F.count("*").alias("tiles"), F.round(F.sum("length") / 1048576.0, 2).alias("mb"))


def report(rows: DataFrame) -> DataFrame:
    """A Markdown line per change result."""
    return rows.select(F.concat(F.lit("- **"), "change_type", F.lit("** confidence "), F.format_string("%.2f", "confidence")).alias("line"))
