"""External scene catalogues: saved answers of portals as tables of one shape, and provider stubs for the offline case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "product_id string, date timestamp_ntz, cloud double, minx double, miny double, maxx double, maxy double, online boolean, source string"


def normalised(rows: DataFrame, source: str) -> DataFrame:
    """Rows of variant `v` with the portals' different keys to the common columns."""
    get = lambda kind, *paths: F.coalesce(*[F.try_variant_get(F.col("v"), p, kind) for p in paths])
    day = get("string", "$.properties.datetime", "$.ContentDate.Start", "$.acquisitionDate", "$.date", "$.DATE")
    box = get("array<double>", "$.bbox", "$.boundingBox", "$.spatialBounds")
    return rows.select(
        get("string", "$.id", "$.Id", "$.entityId", "$.ID").alias("product_id"),
        F.try_to_timestamp(F.substring(F.translate(day, "T", " "), 1, 19)).cast("timestamp_ntz").alias("date"),
        get("double", "$.properties['eo:cloud_cover']", "$.cloudCover", "$.CloudCover", "$.cloud").alias("cloud"),
        F.get(box, F.lit(0)).alias("minx"), F.get(box, F.lit(1)).alias("miny"), F.get(box, F.lit(2)).alias("maxx"), F.get(box, F.lit(3)).alias("maxy"),
        F.coalesce(get("boolean", "$.Online", "$.online"), F.lit(True)).alias("online"),
        F.lit(source).alias("source"),
    )


def read_catalog(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A saved answer, one JSON object a line."""
    return normalised(spark.read.text(path).select(F.try_parse_json("value").alias("v")), source)


def found(catalog: DataFrame, box: tuple[float, float, float, float], start: str, end: str, max_cloud: float | None, top: int = 50) -> DataFrame:
    """The newest scenes that meet the box within the dates and the cloud limit."""
    meets = (F.col("maxx") >= box[0]) & (F.col("minx") <= box[2]) & (F.col("maxy") >= box[1]) & (F.col("miny") <= box[3])
    days = (F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("date") <= F.lit(end + " 23:59:59").cast("timestamp_ntz"))
    clear = F.lit(True) if max_cloud is None else F.coalesce("cloud", F.lit(0.0)) <= max_cloud
    return catalog.where(meets & days & clear).orderBy(F.col("date").desc(), "product_id").limit(top)


class OfflineProvider(DataSource):
    """A provider without network: its searches give no rows, with the common columns."""

    @classmethod
    def name(cls) -> str:
        return "offline_catalog"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        class Reader(DataSourceReader):
            def read(self, partition: InputPartition):
                return iter(())

        return Reader()


PROVIDERS = {name: OfflineProvider for name in ("sentinel2", "bhuvan", "mosdac")}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfflineProvider)
