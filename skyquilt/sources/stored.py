"""Tables kept as committed batches of Parquet: a batch counts whole or not at all, once, and the newest row of a key stands.

A table is a folder: `data/batch=NAME` has the rows of a batch, sorted by key so that a scan for keys skips files
and row groups by their bounds; `commits` has a row (batch, number, replaces) a committed batch. A batch whose write was lost
is in no commit and is not read. Batches are few (a row of driver memory each) and `compact` makes one of them.
One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "batch string, number long, replaces array<string>"


def commits(spark: SparkSession, folder: str) -> dict[str, int]:
    """Number by name of the batches that are in force."""
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{folder}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    gone = {b for r in rows for b in r["replaces"]}
    return {r["batch"]: r["number"] for r in rows if r["batch"] not in gone}


def _known(spark: SparkSession, folder: str, batch: str) -> bool:
    try:
        return not spark.read.schema(COMMITS).parquet(f"{folder}/commits").where(F.col("batch") == batch).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _written(rows: DataFrame, folder: str, batch: str, key: list[str]) -> None:
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(f"{folder}/data/batch={batch}")


def _committed(spark: SparkSession, folder: str, batch: str, replaces: list[str]) -> None:
    number = max(commits(spark, folder).values(), default=0) + 1
    spark.createDataFrame([(batch, number, replaces)], COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def commit(rows: DataFrame, folder: str, batch: str, key: list[str], removed: bool = False) -> bool:
    """Put rows into the table, or take the keys of `rows` out of it; False if the batch was committed before, even if it has been compacted since."""
    spark = rows.sparkSession
    if _known(spark, folder, batch):
        return False
    rows = rows.select(*key) if removed else rows
    _written(rows.withColumn("_removed", F.lit(removed)), folder, batch, key)
    _committed(spark, folder, batch, [])
    return True


def current(spark: SparkSession, folder: str, key: list[str], schema: str, order: str | None = None) -> DataFrame:
    """The table: for each key its row with the largest `order`, of equal ones that of the latest batch; of equal ones there, any one.

    A removal outweighs what was committed before it, and nothing that comes later. Columns that a batch lacks are null.
    """
    names = commits(spark, folder)
    if not names:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/data/batch={b}" for b in names]
    rows = spark.read.schema(f"{schema}, _removed boolean, batch string").option("basePath", f"{folder}/data").parquet(*paths)
    number = spark.createDataFrame(list(names.items()), "batch string, _number long")
    rows = rows.join(F.broadcast(number), "batch")  # a row a batch
    by_key = Window.partitionBy(*key)
    rows = rows.withColumn("_last", F.max(F.when(F.col("_removed"), F.col("_number"))).over(by_key))
    rows = rows.where(~F.col("_removed") & (F.col("_last").isNull() | (F.col("_number") > F.col("_last"))))
    newest = [F.col(order).desc_nulls_last()] if order else []
    return rows.withColumn("_rn", F.row_number().over(by_key.orderBy(*newest, F.col("_number").desc()))).where("_rn = 1").drop("_rn", "_last", "_number", "_removed", "batch")


def compact(spark: SparkSession, folder: str, batch: str, key: list[str], schema: str, order: str | None = None) -> None:
    """Make one batch of all; until its commit the old ones are read, from then on they aren't."""
    old = sorted(commits(spark, folder))
    if len(old) > 1 and not _known(spark, folder, batch):
        _written(current(spark, folder, key, schema, order).withColumn("_removed", F.lit(False)), folder, batch, key)
        _committed(spark, folder, batch, old)
