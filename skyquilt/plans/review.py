"""The review queue of change results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import scalar as S

from .search import REVIEW_STEP, adjusted


def queue(results: DataFrame, tiles: DataFrame, scenes: DataFrame, feedback: DataFrame, status: str = "all", limit: int = 100) -> DataFrame:
    """The newest result of each analysis with its tiles and scenes, pending ones first, then by priority and confidence."""
    key = F.coalesce("analysis_key", F.concat_ws(":", F.col("before_tile_id").cast("string"), F.col("after_tile_id").cast("string")))
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc_nulls_last(), F.col("change_id").desc())
    newest = results.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    side = lambda tag: tiles.select(F.col("tile_id").alias(f"{tag}_tile_id"), F.col("scene_id").alias(f"{tag}_scene_id"), F.col("ts").alias(f"{tag}_ts"), F.col("lon").alias(f"{tag}_lon"), F.col("lat").alias(f"{tag}_lat"))
    scene = lambda tag: scenes.select(F.col("scene_id").alias(f"{tag}_scene_id"), F.col("source_filename").alias(f"{tag}_file"))
    rows = newest.join(side("before"), "before_tile_id").join(side("after"), "after_tile_id").join(scene("before"), "before_scene_id", "left").join(scene("after"), "after_scene_id", "left")
    said = feedback.where("target_type = 'change_result'").groupBy(F.col("target_id").alias("change_id")).agg(
        F.count_if(F.col("verdict") == "confirm").alias("confirms"), F.count_if(F.col("verdict") == "reject").alias("rejects"), F.max_by("verdict", F.struct("created_at", "feedback_id")).alias("_last")
    )
    rows = rows.join(said, "change_id", "left").withColumn("status", F.when(F.col("_last") == "confirm", "confirmed").when(F.col("_last") == "reject", "rejected").otherwise("pending"))
    rows = rows.withColumn("priority", F.round(adjusted(F.coalesce("confidence", S.num(0)), F.col("confirms"), F.col("rejects"), REVIEW_STEP), 4))
    rows = rows if status == "all" else rows.where(F.col("status") == status)
    return rows.drop("_last").orderBy(F.col("status") != "pending", F.col("priority").desc(), F.col("confidence").desc_nulls_last(), "change_id").limit(limit)
