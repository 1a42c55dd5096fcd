"""The change-point rule over streams against the batch rule."""

import datetime as dt
import random

import pytest

from skyquilt.operators import series
from skyquilt.streaming import points

DDL = "series_id long, ts timestamp, pass_id long, score double, valid boolean"
COLUMNS = ["series_id", "status", "onset", "confirmed", "uncertainty_days", "lag_days", "transients"]
DAY = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, late, **rule):
    """What the stream says in the end, a file a batch; and all it said."""
    src = tmp_path / "in"
    src.mkdir(exist_ok=True)
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(DDL).parquet(str(src))
        said = points.run(points.change_point_stream(stream, late, **rule), str(tmp_path / "out"))
    return points.latest(said), said


def batch_rule(spark, rows, **rule):
    return series.change_points(spark.createDataFrame(rows, DDL), ["series_id"], "ts", order=["ts", "pass_id"], **rule)


def tuples(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def made(seed, n=40, most=16):
    rng = random.Random(seed)
    return [(s, DAY + dt.timedelta(days=i // 2 if s % 5 == 0 else i, hours=s % 3), i, rng.random(), rng.random() > 0.2) for s in range(n) for i in range(rng.randint(1, most))]


def test_shuffled_batches_equal_the_batch_rule(spark, tmp_path):
    rows = made(1)
    random.Random(2).shuffle(rows)
    rule = {"baseline": 3, "persistence": 2, "threshold": 0.6}
    got, said = run(spark, tmp_path, [rows[i::3] for i in range(3)], "60 days", **rule)
    assert tuples(got) == tuples(batch_rule(spark, rows, **rule))
    assert {r["status"] for r in got.select("status").collect()} == {"confirmed", "transient_only", "no_change", "insufficient_data"}
    assert said.count() > got.count()


def test_passes_settle_behind_the_watermark(spark, tmp_path):
    """In batches by time, each shuffled, with little patience: what has settled is kept as state and the end is the same."""
    rows = made(3)
    cuts = [[r for r in rows if a <= (r[1] - DAY).days < a + 4] for a in range(0, 16, 4)]
    for c in cuts:
        random.Random(4).shuffle(c)
    rule = {"baseline": 2, "persistence": 3, "threshold": 0.4}
    got, _ = run(spark, tmp_path, cuts, "1 day", **rule)
    assert tuples(got) == tuples(batch_rule(spark, rows, **rule))
    # all that lies a day or more behind the last pass is settled
    last = max(r[1] for r in rows)
    old = {s for s in {r[0] for r in rows} if max(r[1] for r in rows if r[0] == s) < last - dt.timedelta(days=2)}
    settled = {r["series_id"] for r in got.where("settled").collect()}
    assert old and old <= settled


def test_late_passes_withdraw_what_was_said(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(days=i)
    first = [(1, day(0), 0, 0.1, True), (1, day(5), 1, 0.9, True), (1, day(15), 3, 0.9, True)]
    rule = {"baseline": 1, "persistence": 2, "threshold": 0.5}
    got, said = run(spark, tmp_path, [first, [(1, day(10), 2, 0.1, True)]], "30 days", **rule)
    r = got.collect()[0]
    assert (r["status"], r["transients"], r["tail"], r["passes"], r["settled"]) == ("transient_only", 2, 1, 4, False)
    assert {x["status"] for x in said.collect()} == {"confirmed", "transient_only"}


def test_passes_behind_the_watermark_are_dropped(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(days=i)
    first = [(1, day(0), 0, 0.1, True), (1, day(5), 1, 0.9, True), (1, day(15), 3, 0.9, True), (2, day(40), 4, 0.1, True)]
    got, _ = run(spark, tmp_path, [first, [(1, day(10), 2, 0.1, True), (2, day(41), 5, 0.1, True)]], "3 days", baseline=1, persistence=2, threshold=0.5)
    r = got.where("series_id = 1").collect()[0]
    assert (r["status"], r["onset"], r["settled"], r["uncertainty_days"], r["lag_days"]) == ("confirmed", day(5), True, 5.0, 10.0)


def test_odd_rows(spark, tmp_path):
    """Passes without time, score or judgement, repeated ones, and a series of nothing else."""
    rows = [(1, None, 0, 0.9, True), (1, DAY, 1, None, True), (1, DAY, 2, 0.1, None), (2, DAY, 3, 0.1, True), (2, DAY, 3, 0.1, True), (3, None, 1, 0.1, True)]
    got, _ = run(spark, tmp_path, [rows], "1 day", baseline=1, persistence=2, threshold=0.5)
    assert {r["series_id"]: (r["status"], r["passes"]) for r in got.collect()} == {1: ("insufficient_data", 2), 2: ("no_change", 2)}
    with pytest.raises(ValueError):
        points.change_point_stream(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), persistence=1)
