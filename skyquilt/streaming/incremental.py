"""Streams: idempotent incremental ingestion and fixed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def ingest_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Take the new files of a folder once, and append the rows whose key the target lacks.

    The checkpoint makes a file count once; the anti join makes a batch that is run again
    after a failure add nothing twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        rows = prepare(batch).dropDuplicates(key)
        try:
            known = batch.sparkSession.read.parquet(target).select(*key)
            rows = rows.join(known, key, "left_anti")
        except Exception as e:  # no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, ts: str, width: str, late: str, key: list[str], value: str) -> DataFrame:
    """Counts and means in fixed windows, with a bound on late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


class Progress(StreamingQueryListener):
    """Rows per batch of each query."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


__all__ = ["Progress", "ingest_files", "tumbling"]
