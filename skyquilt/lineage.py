"""Cutting lineage in long plans and in iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it from there.

    A table's size is known, where a checkpoint keeps the estimate of its plan, which joins in a loop multiply.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the tables that `cut` wrote and `df` reads, once nothing else will read them: rounds would leave all of theirs behind."""
    spark = df.sparkSession
    for table in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(table).startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
