"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of code points other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    The folder is the one of ``spark.checkpoint.dir``. Where that is unset a temporary one
    is made if all runs on one machine; on a cluster that is an error. A checkpoint keeps the size estimate of its plan,
    which a loop of joins multiplies round by round until it is too long a number to work
    with; in loops, `forget` drops it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    out = df.checkpoint(eager=True)
    if forget:
        jdf = out._jdf
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
    return out


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all rows before this one in `order`.

    No task sees more than a range of the rows: rows are dealt by range of `order`, summed
    within each range, and each range starts from the total of those before it. `order`
    should end in a unique key, as equal rows go to one range. The dealt rows are
    checkpointed, since ranges drawn anew could differ.
    """
    kept = df.columns
    dealt = cut(df.repartitionByRange(parts_of(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value.cast("long")))
    # one row for each range
    starts = dealt.groupBy("_range").agg(F.sum("_value").alias("_t")).select("_range", (F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_start"))
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_range").select(*kept, (F.col("_within") + F.col("_start")).alias(name))


def bucket_totals(df: DataFrame, group: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """For each (group, bucket): `name`, the sum of `value` over the group's earlier buckets.

    With buckets from a uniform hash this makes a running total over a hot group in two
    levels: here over few buckets, and within a bucket by a window.
    """
    per = df.groupBy(*group, bucket).agg(F.sum(value).cast("long").alias("_t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*group, bucket, (F.sum("_t").over(before) - F.col("_t")).alias(name))


#: Keys with more than this share of all rows are joined by broadcast; there are at most its inverse.
HOT_SHARE = 1 / 1000


def attach(rows: DataFrame, per: DataFrame, keys: list[str], values: list[str], count: str) -> DataFrame:
    """Left join of `rows` with `per`, which has one row for each of `keys` (nulls are equal) and the number of its rows, `count`.

    Keys with over a thousandth of the counted rows, at most 1,000, are broadcast; their rows
    are spread over the shuffle that joins the rest, where they meet nothing.
    `per` is read three times.
    """
    total = per.agg(F.sum(count)).first()[0] or 0
    named = per.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_v"), F.col(count).alias("_n"))

    def same(prefix: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(k).eqNullSafe(F.col(prefix + k))
        return out

    hot = named.where(F.col("_n") > total * HOT_SHARE).select(*[f"_{k}" for k in keys], F.col("_v").alias("_hot"))
    cold = named.where(F.col("_n") <= total * HOT_SHARE).select(*[F.col(f"_{k}").alias(f"__{k}") for k in keys], "_v", F.lit(-1).cast("long").alias("__salt"))
    out = rows.join(F.broadcast(hot), same("_"), "left").drop(*[f"_{k}" for k in keys])
    out = out.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    out = out.join(cold, same("__") & (F.col("_salt") == F.col("__salt")), "left")
    got = F.coalesce("_hot", "_v")
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def stored(df: DataFrame, *by: str) -> DataFrame:
    """`df` as a table in the shared checkpoint folder, in one folder for each value of `by`; its size is known to the planner."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
