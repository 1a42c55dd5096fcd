"""Transverse Mercator in columns, by Krueger's series in the third flattening; all UTM zones, both ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid, the scale at the central meridian, and the false origin.
A, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
E = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: The rectifying radius and the series of both ways, to the fourth power of N (under a tenth of a millimetre within a zone).
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BACKWARD = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def zone_of(lon: Column) -> Column:
    """The zone, 1 to 60, of a longitude (the plain rule of six degrees)."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def _meridian(zone: Column) -> Column:
    return zone * 6 - 183


def _with(values: dict[str, Column], then) -> Column:
    """What `then` makes of some values, each worked out once: a column used many times would be written out each time."""
    return F.get(F.transform(F.array(F.struct(*[c.cast("double").alias(n) for n, c in values.items()])), then), F.lit(0))


def _sum(start: Column, series: tuple, term) -> Column:
    return reduce(lambda s, x: s + F.lit(x[1]) * term(2 * x[0]), enumerate(series, 1), start)


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """struct(x, y): metres in a zone; `south` adds the southern false northing."""

    def metres(v: Column) -> Column:
        x = _sum(v["eta"], FORWARD, lambda k: F.cos(k * v["xi"]) * F.sinh(k * v["eta"]))
        y = _sum(v["xi"], FORWARD, lambda k: F.sin(k * v["xi"]) * F.cosh(k * v["eta"]))
        return F.struct((EAST + SCALE * RADIUS * x).alias("x"), (SCALE * RADIUS * y + v["north"]).alias("y"))

    def angles(v: Column) -> Column:
        return _with({"xi": F.atan2(v["t"], F.cos(v["d"])), "eta": F.asinh(F.sin(v["d"]) / F.sqrt(v["t"] * v["t"] + F.cos(v["d"]) * F.cos(v["d"]))), "north": v["north"]}, metres)

    s = F.sin(F.radians(lat))
    start = {"t": F.sinh(F.atanh(s) - E * F.atanh(E * s)), "d": F.radians(F.pmod(lon - _meridian(zone) + 180, F.lit(360.0)) - 180), "north": F.when(south, SOUTH).otherwise(0.0)}
    return _with(start, angles)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct(lon, lat): degrees of metres in a zone."""

    def degrees(v: Column) -> Column:
        phi = _sum(v["chi"], LATITUDE, lambda k: F.sin(k * v["chi"]))
        return F.struct((F.pmod(v["lon"] + 180, F.lit(360.0)) - 180).alias("lon"), F.degrees(phi).alias("lat"))

    def sphere(v: Column) -> Column:
        return _with({"chi": F.asin(F.sin(v["u"]) / F.cosh(v["v"])), "lon": v["middle"] + F.degrees(F.atan2(F.sinh(v["v"]), F.cos(v["u"])))}, degrees)

    def angles(v: Column) -> Column:
        minus = tuple(-b for b in BACKWARD)
        u = _sum(v["xi"], minus, lambda k: F.sin(k * v["xi"]) * F.cosh(k * v["eta"]))
        w = _sum(v["eta"], minus, lambda k: F.cos(k * v["xi"]) * F.sinh(k * v["eta"]))
        return _with({"u": u, "v": w, "middle": v["middle"]}, sphere)

    start = {"xi": (y - F.when(south, SOUTH).otherwise(0.0)) / (SCALE * RADIUS), "eta": (x - EAST) / (SCALE * RADIUS), "middle": _meridian(zone)}
    return _with(start, angles)


def to_degrees(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) of coordinates in a UTM zone (EPSG 326xx north, 327xx south); others are taken for degrees, and other projected systems are null."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    back = from_utm(x, y, epsg % 100, epsg >= 32700)
    own = F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    return F.when(F.coalesce(utm, F.lit(False)), back).when(epsg.isNull() | (epsg == 4326), own)
