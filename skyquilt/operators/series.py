"""Operators on ordered series: first and best per key, gaps, windows of time, and change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.lineage import cut


def best_per(rows: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key; `order` ends in a unique column."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def head_and_tail(rows: DataFrame, key: list[str], order: list[str], most: int = 12, head: int = 4, tail: int = 8) -> DataFrame:
    """All rows of a key with up to `most` of them, else the first `head` and the last `tail`."""
    up = Window.partitionBy(*key).orderBy(*order)
    down = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    ranked = rows.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return ranked.where((F.col("_n") <= most) | (F.col("_up") <= head) | (F.col("_down") <= tail)).drop("_up", "_down", "_n")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "index") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def gaps(rows: DataFrame, key: list[str], ts: str, order: list[str]) -> DataFrame:
    """Add the days since the row before: gap_days, null on the first."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("gap_days", F.timestamp_diff("SECOND", before, F.col(ts)) / F.lit(86400.0))


def first_and_last(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """first_v and last_v of each value, and n, by one aggregate."""
    at = F.struct(*order)
    outs = [e for v in values for e in (F.min_by(v, at).alias(f"first_{v}"), F.max_by(v, at).alias(f"last_{v}"))]
    return rows.groupBy(*key).agg(*outs, F.count("*").alias("n"))


def cadence(bounds: DataFrame, days: int) -> DataFrame:
    """start and stop of consecutive windows of `days` between first and final; the last is cut short."""
    starts = bounds.withColumn("start", F.explode(F.sequence(F.to_date("first"), F.to_date("final"), F.expr(f"interval {days} days"))))
    return starts.withColumn("stop", F.least(F.date_add("start", days - 1), F.to_date("final")))


def last_turns(rows: DataFrame, key: str, order: str, most: int = 8) -> DataFrame:
    """The last `most` rows of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("_rn") <= most).drop("_rn")


def last_known(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    return rows.withColumn(name, F.last_value(value, True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def baseline_marked(rows: DataFrame, key: list[str], order: list[str], baseline: int) -> DataFrame:
    """Add valid_no, the count of valid passes so far, and in_baseline, for the first `baseline` valid ones."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("valid"), 1).otherwise(0)).over(so_far)
    return rows.withColumn("valid_no", n).withColumn("in_baseline", F.col("valid") & (F.col("valid_no") <= baseline))


def change_points(rows: DataFrame, key: list[str], ts: str, baseline: int = 3, persistence: int = 2, threshold: float = 0.5, order: list[str] | None = None) -> DataFrame:
    """One row per series: status, onset, confirmed, uncertainty_days, lag_days, transients.

    rows: key, ts, score, valid. The first `baseline` valid passes are the baseline. Behind it,
    valid passes at or over the threshold make runs and a valid pass below ends one; invalid
    passes are skipped. The first run of `persistence` passes is confirmed: onset is its first
    pass and confirmed its last needed one; later passes are not looked at. Passes of runs that
    ended before are transient.
    """
    if baseline < 1 or persistence < 2 or not 0 < threshold:
        raise ValueError("baseline >= 1, persistence >= 2 and threshold > 0 are needed")
    order = order or [ts]
    every = rows.select(*key).distinct()
    valid = rows.where("valid")
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = valid.withColumn("_rn", F.row_number().over(w))
    scanned = ranked.where(F.col("_rn") > baseline).withColumn("_over", F.col("score") >= threshold)
    scanned = scanned.withColumn("_island", F.sum(F.when(F.col("_over"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = scanned.where("_over").withColumn("_at", F.row_number().over(Window.partitionBy(*key, "_island").orderBy(*order)))
    runs = over.groupBy(*key, "_island").agg(F.count("*").alias("_length"), F.min(ts).alias("_onset"), F.min(F.when(F.col("_at") == persistence, F.col(ts))).alias("_confirmed"), F.min("_rn").alias("_start"))
    hit = runs.where(F.col("_length") >= persistence).groupBy(*key).agg(F.min_by(F.struct("_island", "_onset", "_confirmed", "_start"), "_island").alias("hit"))
    clear = scanned.where("not _over").join(hit, key).where(F.col("_rn") < F.col("hit._start")).groupBy(*key).agg(F.max(ts).alias("_clear"))
    base_end = ranked.where(F.col("_rn") == baseline).select(*key, F.col(ts).alias("_base_end"))
    counts = scanned.groupBy(*key).agg(F.count("*").alias("_scanned"))
    passing = runs.join(hit, key, "left").where(F.col("hit").isNull() | (F.col("_island") < F.col("hit._island"))).groupBy(*key).agg(F.sum("_length").alias("_transients"))
    out = every
    for part in (hit, clear, base_end, counts, passing):
        out = out.join(part, key, "left")
    confirmed = F.col("hit").isNotNull()
    status = (
        F.when(F.col("_base_end").isNull() | F.col("_scanned").isNull(), "insufficient_data").when(confirmed, "confirmed").when(F.col("_transients") > 0, "transient_only").otherwise("no_change")
    )
    days = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / F.lit(86400e6)
    last_clear = F.coalesce("_clear", "_base_end")
    return out.select(
        *key,
        status.alias("status"),
        F.col("hit._onset").alias("onset"),
        F.col("hit._confirmed").alias("confirmed"),
        F.when(confirmed, F.round(days(last_clear, F.col("hit._onset")), 3)).alias("uncertainty_days"),
        F.when(confirmed, F.round(days(F.col("hit._onset"), F.col("hit._confirmed")), 3)).alias("lag_days"),
        F.coalesce("_transients", F.lit(0)).cast("long").alias("transients"),
    )


def pass_log(rows: DataFrame, key: list[str], ts: str, baseline: int = 3, threshold: float = 0.5) -> DataFrame:
    """What the change-point scan says of each pass: baseline, invalid_pass_skipped, over or below."""
    marked = baseline_marked(rows, key, [ts], baseline)
    event = F.when(~F.col("valid"), "invalid_pass_skipped").when(F.col("in_baseline"), "baseline").when(F.col("score") >= threshold, "over_threshold").otherwise("below_threshold")
    return marked.select(*key, ts, event.alias("event"))


def following(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Add `name`: the next larger value of a unique key over all rows, null for the last; no task sees more than a range of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))
    # one row for each range
    firsts = dealt.groupBy("_range").agg(F.min(key).alias("_first")).select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    within = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return dealt.withColumn("_next", within).join(F.broadcast(firsts), "_range").select(*rows.columns, F.coalesce("_next", "_after").alias(name))
