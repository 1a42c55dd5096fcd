"""Spatial joins by grid cells, nearest landmarks and tile grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.scalar import compass, haversine_km, place_line, slippy_x, slippy_y
from skyquilt.lineage import cut

from . import nearest

#: Fixed value: how far peers may lie apart in degrees of longitude and of latitude.
PEER = 0.006


def band_join(left: DataFrame, right: DataFrame, tolerance: float, keys: list[str] | None = None, suffix: str = "_2") -> DataFrame:
    """Pairs with |lon - lon| and |lat - lat| at most `tolerance` and equal `keys`.

    Cells are a little wider than the tolerance, so partners lie in the same cell or a
    neighbour: the left rows go to their nine cells, the right rows stay in theirs, and the join
    is one on cells with the exact test behind it. Both sides are dealt by cell: a table's files are far
    smaller than its rows, so their size must not have a side collected by the driver.
    """
    width = tolerance * 1.000001
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    a = a.withColumn("_cx", cell("lon") + F.col("_dx")).withColumn("_cy", cell("lat") + F.col("_dy")).drop("_dx", "_dy")
    b = right.select(*[F.col(c).alias(c + suffix) for c in right.columns], cell("lon").alias("_cx"), cell("lat").alias("_cy"))
    same = [F.col(k) == F.col(k + suffix) for k in keys or []]
    on = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"])
    for s in same:
        on = on & s
    near = (F.abs(F.col("lon") - F.col("lon" + suffix)) <= tolerance) & (F.abs(F.col("lat") - F.col("lat" + suffix)) <= tolerance)
    return a.join(b.hint("merge"), on).where(near).drop(a["_cx"], a["_cy"], b["_cx"], b["_cy"])


def nearest_landmark(points: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Add name, zone, feature_type, distance_km, direction and subtitle of the nearest landmark; the first listed wins ties.

    gazetteer: ord, name, zone, lon, lat, feature_type. Each place that points share is looked for once (`nearest.nearest`),
    whatever the distance; of landmarks at one place only the first listed goes on.
    """
    marks = gazetteer.groupBy(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).agg(F.min(F.struct("ord", "name", "zone", "lon", "lat", "feature_type")).alias("g"))
    met = nearest.nearest(points, gazetteer).join(marks.hint("merge"), ["lon2", "lat2"])
    met = met.withColumn("km", haversine_km(F.col("g.lon"), F.col("g.lat"), F.col("lon"), F.col("lat")))
    # places are as many as the points, and few of their columns
    best = cut(met.groupBy("lon", "lat").agg(F.min(F.struct("km", "g.ord", "g")).alias("_best")))
    rows = points.join(best.hint("merge"), ["lon", "lat"], "left").select(*points.columns, "_best")
    g = F.col("_best.g")
    rows = rows.withColumns({"name": g["name"], "zone": g["zone"], "feature_type": g["feature_type"], "distance_km": F.col("_best.km"), "direction": compass(g["lon"], g["lat"], F.col("lon"), F.col("lat"))})
    return rows.withColumn("subtitle", place_line(F.col("name"), F.col("zone"), F.col("distance_km"), F.col("direction"))).drop("_best")


def nearest_to(rows: DataFrame, lon: float, lat: float, key: str, k: int = 1) -> DataFrame:
    """The k rows nearest to a point by squared degrees; ties by key."""
    d = (F.col("lon") - F.lit(lon)) * (F.col("lon") - F.lit(lon)) + (F.col("lat") - F.lit(lat)) * (F.col("lat") - F.lit(lat))
    return rows.withColumn("d2", d).orderBy("d2", key).limit(k)


def slippy_ranges(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """z and the first and last web tile (x0, x1, y0, y1) along each side of each box (west, south, east, north).

    A box over the pole or the date line, whose last tile comes before its first one, has an inverted range.
    """
    z = boxes.withColumn("z", F.explode(F.array(*[F.lit(v) for v in zooms])))
    return z.withColumns({"x0": slippy_x(F.col("west"), F.col("z")), "x1": slippy_x(F.col("east"), F.col("z")), "y0": slippy_y(F.col("north"), F.col("z")), "y1": slippy_y(F.col("south"), F.col("z"))})


def slippy_tiles(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """z, x, y of the web tiles that each box (west, south, east, north) touches; an inverted range has none."""
    along = lambda a, b: F.explode(F.when(F.col(a) <= F.col(b), F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    ranges = slippy_ranges(boxes, zooms)
    return ranges.withColumn("x", along("x0", "x1")).withColumn("y", along("y0", "y1")).drop("x0", "x1", "y0", "y1")


def signed_tiles(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """z, x, y, sign of the web tiles of each box (west, south, east, north): 1 for those that it touches.

    An inverted range, of a box over the pole or the date line, takes away (-1) the tiles between its ends, so that the signs of a box
    add up to the product of its ranges. A box without tiles has one row, with sign 0.
    """
    listed = lambda a, b, sign: F.transform(F.sequence(a, b), lambda v: F.struct(v.alias("v"), F.lit(sign).alias("s")))
    none = F.array().cast("array<struct<v:int,s:int>>")

    def along(a: str, b: str) -> Column:
        a, b = F.col(a), F.col(b)
        return F.explode_outer(F.when(a <= b, listed(a, b, 1)).when(a - b > 1, listed(b + 1, a - 1, -1)).otherwise(none))

    ranges = slippy_ranges(boxes, zooms)
    each = ranges.withColumn("_x", along("x0", "x1")).withColumn("_y", along("y0", "y1"))
    return each.select("z", F.col("_x.v").alias("x"), F.col("_y.v").alias("y"), F.coalesce(F.col("_x.s") * F.col("_y.s"), F.lit(0)).alias("sign"))


def tile_grid(scenes: DataFrame, size: int = 256) -> DataFrame:
    """row_off, col_off, h, w of the windows of each scene (width, height); fragments under half a tile are left out."""
    rows = scenes.withColumn("row_off", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(size)))).withColumn("col_off", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(size))))
    rows = rows.withColumn("h", F.least(F.lit(size), F.col("height") - F.col("row_off"))).withColumn("w", F.least(F.lit(size), F.col("width") - F.col("col_off")))
    return rows.where((F.col("h") >= size // 2) & (F.col("w") >= size // 2))


def window_bounds(rows: DataFrame, west: str = "west", north: str = "north", step_x: str = "step_x", step_y: str = "step_y") -> DataFrame:
    """Bounds and centre of windows in a grid of degrees (other projections need their library and are not offered)."""
    x0 = F.col(west) + F.col("col_off") * F.col(step_x)
    y1 = F.col(north) - F.col("row_off") * F.col(step_y)
    x1, y0 = x0 + F.col("w") * F.col(step_x), y1 - F.col("h") * F.col(step_y)
    return rows.withColumns({"minx": x0, "miny": y0, "maxx": x1, "maxy": y1, "lon": (x0 + x1) / 2, "lat": (y0 + y1) / 2})


def degrees_around(lat: float, km: float) -> tuple[float, float]:
    """Half widths in degrees of a box that holds a circle of `km` at a latitude."""
    return km / (111.32 * max(0.01, math.cos(math.radians(lat)))), km / 110.57
