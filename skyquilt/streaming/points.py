"""The change-point rule over a stream, with passes that arrive late and out of order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A series' place in the rule: valid passes of the baseline, last clear pass, onset and length of the open run, passes of ended runs, passes behind the baseline, confirming pass, all passes.
MACHINE = "seen int, clear long, onset long, run int, transients long, scanned long, confirmed long, passes long"
START = (0, None, None, 0, 0, 0, None, 0)
PASS = "t long, pass_id long, score double, valid boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advanced(machine: tuple, passes: Iterable[tuple], baseline: int, persistence: int, threshold: float) -> tuple:
    """The machine after some more passes (t, pass_id, score, valid), in order. A confirmed one stays."""
    seen, clear, onset, run, transients, scanned, confirmed, n = machine
    for t, _, score, valid in passes:
        n += 1
        if confirmed is not None or not valid:
            continue
        if seen < baseline:
            seen, clear = seen + 1, t
            continue
        scanned += 1
        if score >= threshold:
            onset, run = (onset, run + 1) if run else (t, 1)
            confirmed = t if run == persistence else None
        else:
            clear, onset, run, transients = t, None, 0, transients + run
    return seen, clear, onset, run, transients, scanned, confirmed, n


class ChangePoints(StatefulProcessor):
    """Passes wait until the watermark has gone by them, since earlier ones may still come; then they advance the machine in order."""

    def __init__(self, baseline: int, persistence: int, threshold: float) -> None:
        self.rule = (baseline, persistence, threshold)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", MACHINE)
        self.waiting = handle.getListState("waiting", PASS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.machine.exists() and tuple(self.machine.get())[6] is not None
        new = []
        for frame in rows:  # rows of a confirmed series are read and dropped
            if not done:
                new += zip(*(frame[c].tolist() for c in ("t", "pass_id", "score", "valid")), strict=True)
        if not done:
            yield self.settle(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settle(key, timerValues, [])

    def settle(self, key, timers, new: list[tuple]) -> pd.DataFrame:
        passed = timers.getCurrentWatermarkInMs() * 1000
        held = sorted([*(tuple(p) for p in self.waiting.get()), *new], key=lambda p: p[:2])
        cut = sum(p[0] <= passed for p in held)
        machine = advanced(tuple(self.machine.get()) if self.machine.exists() else START, held[:cut], *self.rule)
        rest = held[cut:]
        if machine[6] is not None:  # nothing more to wait for
            machine, rest = advanced(machine, rest, *self.rule), []
        self.machine.update(machine)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[-1][0] // 1000))
        else:
            self.waiting.clear()
        seen, clear, onset, run, transients, scanned, confirmed, n = advanced(machine, rest, *self.rule)
        if confirmed is not None:
            status, run = "confirmed", 0
        else:
            onset = None
            status = "insufficient_data" if seen < self.rule[0] or not scanned else "transient_only" if transients + run else "no_change"
        row = (key[0], status, onset, confirmed, clear, transients + run, run, n, not rest)
        frame = pd.DataFrame([row], columns=["series_id", "status", "onset", "confirmed", "clear", "transients", "tail", "passes", "settled"])
        return frame.astype({"onset": "Int64", "confirmed": "Int64", "clear": "Int64"})

    def close(self) -> None:
        pass


def change_point_stream(stream: DataFrame, late: str = "30 days", baseline: int = 3, persistence: int = 2, threshold: float = 0.5) -> DataFrame:
    """What `series.change_points` says of each series of a stream, whenever its passes change; run it in update mode.

    stream: series_id, ts timestamp, pass_id long, score, valid. Passes of a series may come in any
    order, up to `late` behind the newest pass of the stream; later ones are dropped by the watermark.
    Passes at one time are in order of pass_id. A pass without time is dropped, one without score or
    `valid` isn't valid. Rows: the columns of the batch rule, `tail` (passes of the last, unconfirmed
    run, which `transients` counts too), `passes` (taken so far) and `settled` (no passes are waiting,
    so that nothing that may still come changes what was said of them). A series holds its
    waiting passes and one row of state; once confirmed and settled it says nothing more.
    The newest word on each series is `latest` of the rows. Needs the RocksDB state store, which `run` sets.
    """
    if baseline < 1 or persistence < 2 or not 0 < threshold:
        raise ValueError("baseline >= 1, persistence >= 2 and threshold > 0 are needed")
    kind = stream.schema["series_id"].dataType.simpleString()
    valid = F.coalesce("valid", F.lit(False)) & F.col("score").isNotNull()
    rows = stream.where("ts is not null").withWatermark("ts", late)
    rows = rows.select("series_id", "ts", F.unix_micros("ts").alias("t"), F.coalesce(F.col("pass_id").cast("long"), F.lit(0)).alias("pass_id"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), valid.alias("valid"))
    out = f"series_id {kind}, status string, onset long, confirmed long, clear long, transients long, tail long, passes long, settled boolean"
    said = rows.groupBy("series_id").transformWithStateInPandas(ChangePoints(baseline, persistence, threshold), out, "Update", "eventTime")
    at = {c: F.timestamp_micros(c) for c in ("onset", "confirmed", "clear")}
    days = lambda a, b: F.when(F.col("confirmed").isNotNull(), F.round(F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / F.lit(86400e6), 3))
    return said.withColumns(at).select("series_id", "status", "onset", "confirmed", days("clear", "onset").alias("uncertainty_days"), days("onset", "confirmed").alias("lag_days"), "transients", "tail", "passes", "settled")


def run(said: DataFrame, folder: str) -> DataFrame:
    """Take what has come for `change_point_stream` until now, and read what it said, then and before. `folder` keeps rows and checkpoint; a run that is lost goes on where it stopped."""
    spark, conf = said.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    # a batch that is run again replaces its own folder
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
    spark.conf.set(conf, ROCKS)
    try:
        said.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    return spark.read.schema(said.schema).parquet(f"{folder}/rows").select(*said.columns)


def latest(said: DataFrame) -> DataFrame:
    """The newest row of each series of what `change_point_stream` wrote."""
    newest = F.max_by(F.struct(*[c for c in said.columns if c != "series_id"]), F.struct("passes", "settled"))
    return said.groupBy("series_id").agg(newest.alias("_r")).select("series_id", "_r.*")
