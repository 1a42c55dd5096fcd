"""Predicates of the catalogue: all are plain column conditions that reach the scan, or driver-side checks of a request."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.scalar import sensor_names

Box = tuple[float, float, float, float]
#: The operational box (west, south, east, north) and the names that stand for no sensor filter.
OPERATIONAL: Box = (87.75, 21.40, 88.65, 23.60)
ANY_SENSOR = ("", "all", "none")
#: Padding in degrees of a landmark's box and of its point.
PAD_BOX, PAD_POINT = 0.04, 0.07


def by_sensor(sensor: Column, wanted: str | None) -> Column:
    if wanted is None or wanted.strip().lower() in ANY_SENSOR:
        return F.lit(True)
    return sensor.isin(*sensor_names(wanted))


def by_dates(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive; a date alone means its first or last second."""
    out = ts.isNotNull()
    if start:
        out &= ts >= F.lit(dt.datetime.fromisoformat(start if len(start) > 10 else f"{start}T00:00:00")).cast("timestamp_ntz")
    if end:
        out &= ts <= F.lit(dt.datetime.fromisoformat(end if len(end) > 10 else f"{end}T23:59:59")).cast("timestamp_ntz")
    return out


def in_box(lon: Column, lat: Column, box: Box) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def polygon_points(shape: object) -> list[tuple[float, float]] | None:
    """The outer ring of a feature, polygon, geometry-like mapping, list of pairs or nested list; None for anything else."""
    if isinstance(shape, dict):
        if shape.get("type") == "Feature":
            return polygon_points(shape.get("geometry"))
        return polygon_points(shape.get("coordinates"))
    if not isinstance(shape, Sequence) or isinstance(shape, str) or not shape:
        return None
    first = shape[0]
    if isinstance(first, Sequence) and not isinstance(first, str) and first and isinstance(first[0], Sequence):
        return polygon_points(first)
    try:
        ring = [(float(p[0]), float(p[1])) for p in shape]
    except (TypeError, ValueError, IndexError):
        return None
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    return ring if len(ring) >= 3 else None


def polygon_box(ring: list[tuple[float, float]]) -> Box:
    xs, ys = zip(*ring)
    return min(xs), min(ys), max(xs), max(ys)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule with the boundary inside; the ring's box comes first so that it reaches the scan."""
    crossings, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            at = (lat - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(x1)
            spans = (lat >= min(y1, y2)) & (lat < max(y1, y2))
            crossings += F.when(spans & (lon < at), 1).otherwise(0)
        turn = (lon - F.lit(x1)) * F.lit(y2 - y1) - (lat - F.lit(y1)) * F.lit(x2 - x1)
        edge |= (turn == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
    return in_box(lon, lat, polygon_box(ring)) & ((crossings % 2 == 1) | edge)


def cloud_at_most(cloud: Column, most: float | None) -> Column:
    """A missing value passes."""
    return F.lit(True) if most is None else cloud.isNull() | (cloud <= most)


def usable(quality: Column, cloud: Column, least_quality: float = 0.4) -> Column:
    return (F.coalesce(quality, F.lit(0.5)) >= least_quality) & (F.coalesce(cloud, F.lit(0.0)) <= 0.85)


def dense_usable(quality: Column, cloud: Column, valid: Column) -> Column:
    return (quality >= 0.4) & (cloud <= 0.35) & (valid >= 0.70)


def overlaps(minx: Column, miny: Column, maxx: Column, maxy: Column, box: Box) -> Column:
    return ~((maxx < box[0]) | (minx > box[2]) | (maxy < box[1]) | (miny > box[3]))


def clipped_box(box: Box, limits: Box = OPERATIONAL) -> Box:
    """The box within the limits; ValueError if it is inverted or lies outside."""
    west, south, east, north = box
    if west >= east or south >= north:
        raise ValueError("the box is inverted")
    out = max(west, limits[0]), max(south, limits[1]), min(east, limits[2]), min(north, limits[3])
    if out[0] >= out[2] or out[1] >= out[3]:
        raise ValueError("the box lies outside the operational area")
    return out


def assert_inside(points: list[tuple[float, float]], limits: Box = OPERATIONAL) -> None:
    if not all(limits[0] <= x <= limits[2] and limits[1] <= y <= limits[3] for x, y in points):
        raise ValueError("a point lies outside the operational area")


def place_box(lon: float, lat: float, box: Box | None = None) -> Box:
    """The search box of a landmark: its own box or its point, padded."""
    if box:
        return box[0] - PAD_BOX, box[1] - PAD_BOX, box[2] + PAD_BOX, box[3] + PAD_BOX
    return lon - PAD_POINT, lat - PAD_POINT, lon + PAD_POINT, lat + PAD_POINT


def meeting_box(view: Box | None, place: Box) -> Box:
    """The view's part of the place's box; the place's box if they do not meet."""
    if view is None:
        return place
    out = max(view[0], place[0]), max(view[1], place[1]), min(view[2], place[2]), min(view[3], place[3])
    return out if out[0] < out[2] and out[1] < out[3] else place


def broadened(rows: DataFrame, inside: Column, least: int = 3) -> DataFrame:
    """Rows inside; all rows if fewer than `least` are. One plan: the count is a one-row aggregate."""
    marked = rows.withColumn("_inside", inside)
    count = marked.where("_inside").limit(least).agg(F.count("*").alias("_n"))
    return marked.join(F.broadcast(count)).where(F.col("_inside") | (F.col("_n") < least)).drop("_inside", "_n")


def scenes_listed(scenes: DataFrame, status: str, include_empty: bool = False) -> DataFrame:
    rows = scenes if status == "all" else scenes.where(F.col("status") == status)
    return rows if include_empty else rows.where(F.col("tile_count") > 0)


def text_match(name: Column, scene_id: Column, sensor: Column, query: str, sensor_query: str = "") -> Column:
    """The query in the name or id in any case, and the sensor's text as it is written."""
    low = query.lower()
    return (F.lower(name).contains(low) | F.lower(scene_id.cast("string")).contains(low)) & sensor.contains(sensor_query)


def at_least(x: Column, floor: float) -> Column:
    """Applied above zero only; a missing value counts as zero."""
    return F.lit(True) if floor <= 0 else F.coalesce(x, F.lit(0.0)) >= floor


def uncovered(windows: DataFrame, covered: DataFrame) -> DataFrame:
    """Windows (start, stop) that hold no covered date (date), compared on days.

    Each covered date falls into few windows of a fixed cadence, so dates are joined by the
    day numbers of a window rather than by comparison.
    """
    days = windows.select("start", "stop", F.explode(F.sequence(F.to_date("start"), F.to_date("stop"))).alias("_day"))
    hit = days.join(covered.select(F.to_date("date").alias("_day")).distinct(), "_day").select("start", "stop").distinct()
    return windows.join(hit, ["start", "stop"], "left_anti")


def latest(rows: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends in a unique column."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
