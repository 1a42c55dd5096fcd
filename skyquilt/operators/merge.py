"""Keyed writes: insert if absent, latest per key, quarantine, feedback and cached analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.scalar import point_id, uuid5


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """All keys, each with its newest row; of equal ones the incoming. New columns of either side are kept."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def inserted(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is new, each once."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def removed(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(keys.select(*key), key, "left_anti")


def present(keys: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    return keys.join(stored.select(*key).distinct(), key, "left_semi")


def tile_ids(tiles: DataFrame, scene_key: str = "scene_id") -> DataFrame:
    """tile_uuid from scene (its source hash, where it has one), window and date, and the point number from it."""
    scene = F.coalesce(F.col("source_hash"), F.col(scene_key).cast("string")) if "source_hash" in tiles.columns else F.col(scene_key).cast("string")
    micros = F.date_format("ts", ".SSSSSS")
    date = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == ".000000", "").otherwise(micros))
    name = F.concat_ws("|", scene, F.col("row_off").cast("string"), F.col("col_off").cast("string"), F.coalesce(date, F.lit("")))
    return tiles.withColumn("tile_uuid", uuid5(name)).withColumn("point_id", point_id(F.col("tile_uuid")))


def scenes_to_ingest(files: DataFrame, scenes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with unknown content (by SHA-256), and ingested scenes with tiles that lack a vector, to be repaired."""
    hashed = files.withColumn("source_hash", F.sha2("content", 256)).dropDuplicates(["source_hash"])
    known = scenes.where("status = 'ingested'")
    fresh = hashed.join(known.select("source_hash"), "source_hash", "left_anti")
    repair = known.join(vectors.select("scene_id").distinct(), "scene_id", "left_anti")
    return fresh, repair


def quarantined(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reasons."""
    judged = rows.withColumn("_errors", errors)
    return judged.where(F.size("_errors") == 0).drop("_errors"), judged.where(F.size("_errors") > 0).withColumn("status_reason", F.array_join("_errors", "; ")).drop("_errors")


def current_quarantine(quarantine: DataFrame, ingested: DataFrame, key: str = "source_filename") -> DataFrame:
    """Quarantine rows that no later success has made stale."""
    done = ingested.groupBy(key).agg(F.max("ingested_at").alias("_done"))
    return quarantine.join(done, key, "left").where(F.col("_done").isNull() | (F.col("_done") < F.col("ingested_at"))).drop("_done")


def accepted_feedback(feedback: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on known targets (target_type, target_id), and the rest."""
    key = ["target_type", "target_id"]
    known = targets.select(*key).distinct()
    return feedback.join(known, key, "left_semi"), feedback.join(known, key, "left_anti")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    (rows.write.mode("append").partitionBy(*by) if by else rows.write.mode("append")).parquet(path)


def drop_tables(spark, names: list[str], sure: bool = False) -> None:
    """Drop tables; only if `sure`."""
    if not sure:
        raise ValueError("dropping tables needs sure=True")
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
