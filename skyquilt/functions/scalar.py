"""Scalar column expressions of the domain: defaults, hashes, text, ranking, quality and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ask for physical change.
CHANGE_WORDS = ("built", "change", "changed", "cleared", "clearance", "constructed", "construction", "developed", "development", "expanded", "expansion", "new", "recent")
#: Of these, the ones that ask for building and for clearing.
BUILD_WORDS = ("built", "constructed", "construction", "developed", "development", "expanded", "expansion", "new")
CLEAR_WORDS = ("cleared", "clearance")
#: Ranking weights of plain and of change queries.
WEIGHTS = {"semantic": 0.45, "geo": 0.15, "metadata": 0.10, "quality": 0.15, "change": 0.15}
CHANGE_WEIGHTS = {"semantic": 0.45, "geo": 0.10, "metadata": 0.0, "quality": 0.10, "change": 0.35}
#: Kilometres of a degree of longitude and latitude, the cut-off and the flat core of geographic relevance, and its spread.
KM_LON, KM_LAT, GEO_CUT, GEO_CORE, GEO_SPREAD = 102.8, 111.0, 12.0, 2.0, 2.5
#: Names of the sensor families.
FAMILIES = {
    "sentinel2": ("Sentinel-2", "Sentinel-2 MSI", "Sentinel2", "sentinel-2", "sentinel2", "MSI", "msi", "s2", "S2"),
    "sentinel1": ("Sentinel-1", "Sentinel-1 SAR", "Sentinel1", "sentinel-1", "sentinel1", "SAR-C", "sar-c", "SAR", "sar", "s1", "S1", "C-SAR"),
    "landsat": ("Landsat-8", "Landsat-8 OLI", "Landsat8", "landsat-8", "landsat8", "Landsat 8/9 C2L2", "OLI", "oli", "OLI_TIRS", "TIRS", "Landsat", "landsat"),
}
#: Fixed value: the DNS-free namespace of version-5 UUIDs for URLs (RFC 4122).
UUID_URL = "6ba7b8119dad11d180b400c04fd430c8"


def num(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def or_default(x: Column, default: Column | float) -> Column:
    """The default for null and for zero."""
    default = default if isinstance(default, Column) else num(default)
    return F.when(x.isNull() | (x == 0), default).otherwise(x)


def point_id(key: Column) -> Column:
    """The 60-bit number from the first 15 hexadecimal digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def uuid5(name: Column, namespace: str = UUID_URL) -> Column:
    """The version-5 UUID of a name, as text."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    fourth = F.concat(variant, F.substring(h, 18, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, fourth, F.substring(h, 21, 12))


def analysis_key(lon: Column, lat: Column, date_from: Column, date_to: Column, baseline: Column, persistence: Column, threshold: Column, tiles: Column) -> Column:
    """The SHA-256 that names an analysis by its place, dates, settings and tiles in order."""
    six, four = (lambda x: F.format_string("%.6f", x)), (lambda x: F.format_string("%.4f", x))
    return F.sha2(F.concat_ws("|", six(lon), six(lat), date_from, date_to, baseline.cast("string"), persistence.cast("string"), four(threshold), F.array_join(tiles, "|")), 256)


def sensor_names(sensor: str) -> list[str]:
    """All names of the family of a sensor; of an unknown one, itself in both cases."""
    plain = sensor.lower().translate(str.maketrans("", "", "-_ "))
    names = {sensor, sensor.lower(), sensor.upper()}
    if "sentinel2" in plain or "msi" in plain or plain == "s2":
        names.update(FAMILIES["sentinel2"])
    elif "sentinel1" in plain or "sar" in plain or plain == "s1":
        names.update(FAMILIES["sentinel1"])
    elif "landsat" in plain or "oli" in plain:
        names.update(FAMILIES["landsat"])
    return sorted(names)


def modality(sensor: Column) -> Column:
    return F.when(F.lower(sensor).rlike("sar|radar"), "sar").otherwise("optical")


def plain_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def parsed_time(text: Column) -> Column:
    """A timestamp from the first 19 characters in one of the usual forms; null if none fits."""
    head = F.substring(text, 1, 19)
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def change_words(query: Column) -> Column:
    """The sorted change words among a query's tokens."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(w) for w in CHANGE_WORDS])))


def calibrated(similarity: Column, placeholder: bool = False) -> Column:
    return clip(similarity) if placeholder else clip((similarity - num(0.15)) / num(0.14))


def final_score(similarity: Column, quality: Column, geo: Column, metadata: Column, change: Column, change_query: bool = False, placeholder: bool = False) -> Column:
    """The weighted rank score, gated by low similarity and by distance, to 4 places."""
    w = CHANGE_WEIGHTS if change_query else WEIGHTS
    cal = calibrated(similarity, placeholder)
    gate = F.when(cal < 0.15, cal / num(0.15)).otherwise(num(1))
    near = F.when(geo < 0.999, F.pow(geo, num(1.5))).otherwise(num(1))
    base = cal * num(w["semantic"]) + geo * num(w["geo"]) + metadata * num(w["metadata"]) + quality * num(w["quality"]) + clip(F.coalesce(change, num(0))) * num(w["change"])
    return F.round(clip(base * gate * near), 4)


def geo_relevance(dlon: Column, dlat: Column) -> Column:
    """1 within the core, a Gaussian beyond, null past the cut-off."""
    d = F.sqrt(F.pow(dlon * num(KM_LON), num(2)) + F.pow(dlat * num(KM_LAT), num(2)))
    fall = F.exp(num(-0.5) * F.pow((d - num(GEO_CORE)) / num(GEO_SPREAD), num(2)))
    return F.when(d > GEO_CUT, F.lit(None).cast("double")).when(d <= GEO_CORE, num(1)).otherwise(fall)


def quality_score(cloud: Column, valid: Column, sharp: Column) -> Column:
    return clip(num(0.45) * (num(1) - cloud) + num(0.35) * valid + num(0.20) * sharp)


def land_cover(ndvi: Column, ndwi: Column, ndbi: Column, sensor: Column, brightness: Column, feature: Column, zone: Column) -> Column:
    """A descriptive label from mean indices, mean brightness (null below three bands), the sensor and the nearest landmark's kind and zone."""
    has = lambda word: F.coalesce(feature, F.lit("")).contains(word)
    bright = lambda v: F.coalesce(brightness > v, F.lit(False))
    wet = has("wetland") | F.lower(F.coalesce(zone, F.lit(""))).contains("wetland")
    radar = F.when(ndbi > -0.486, "RADAR HIGH-SCATTER URBAN STRUCTURE").when(ndbi < -0.490, "RADAR SMOOTH SURFACE / WATERWAY").otherwise("RADAR MIXED TERRAIN & BUILT-UP")
    dense = (
        F.when(has("transit") | has("railway"), "TRANSIT INFRASTRUCTURE & TERMINAL")
        .when(has("port") | has("maritime"), "PORT & MARITIME LOGISTICS")
        .when(has("commercial") | has("it"), "HIGH-DENSITY COMMERCIAL FABRIC")
        .when(has("airport"), "AIRPORT & RUNWAY INFRASTRUCTURE")
        .otherwise("HIGH-DENSITY URBAN BUILT-UP")
    )
    return (
        F.when(F.upper(sensor).contains("SAR"), radar)
        .when((ndwi > 0.05) | ((ndwi > -0.15) & (ndvi < -0.05) & (ndbi < -0.15)), F.when(wet, "WETLAND & AQUACULTURE BASIN").otherwise("HOOGHLY WATERWAY & AQUATIC BASIN"))
        .when((ndwi > -0.10) & (ndvi > 0.05) & (ndbi < -0.10), "WETLAND & RIPARIAN SHORELINE")
        .when(ndvi > 0.30, "DENSE VEGETATED CANOPY / WOODLAND")
        .when(ndvi > 0.15, F.when(has("park") | has("lake"), "URBAN PARKLAND & CIVIC GREEN").otherwise("VEGETATED CANOPY & MIXED GREENS"))
        .when((ndvi > 0.05) & (ndbi < -0.10), "AGRICULTURAL CULTIVATION / AGRO-TERRAIN")
        .when((ndbi > 0.04) | (bright(130) & (ndvi < 0)), dense)
        .when((ndbi > -0.08) | bright(85), F.when(has("residential"), "PLANNED RESIDENTIAL URBAN FABRIC").otherwise("URBAN RESIDENTIAL DEVELOPMENT"))
        .when((ndbi < -0.20) & (ndvi < 0.05), "OPEN TERRAIN & LOW-REFLECTIVE GROUND")
        .otherwise("MIXED URBAN & PERI-URBAN TERRAIN")
    )


def region_type(elongation: Column, aspect: Column, solidity: Column, d_ndvi: Column, d_ndwi: Column, d_ndbi: Column, before_ndbi: Column, after_ndbi: Column, after_ndwi: Column, after_ndvi: Column) -> Column:
    """struct(change_type, dynamics, confidence) of a changed region by ordered rules."""

    def out(kind: str, dynamics: Column | str, confidence: Column) -> Column:
        dynamics = dynamics if isinstance(dynamics, Column) else F.lit(dynamics)
        return F.struct(F.lit(kind).alias("change_type"), dynamics.alias("dynamics"), F.round(confidence, 3).alias("confidence"))

    grows = F.when(d_ndwi > 0, "expansion").otherwise("contraction")
    return (
        F.when(
            ((elongation > 2.8) | ((aspect > 3.0) & (solidity < 0.6))) & ((d_ndbi > -0.15) | (after_ndbi > -0.10)),
            out("road_development", F.when(elongation > 3.5, "appearance").otherwise("expansion"), F.least(num(0.95), num(0.65) + num(0.05) * F.least(elongation, num(6)))),
        )
        .when(
            (d_ndbi > 0.10) | ((after_ndbi > 0) & (d_ndbi > 0.04)),
            out("construction", F.when(before_ndbi < -0.05, "appearance").otherwise("expansion"), F.least(num(0.95), num(0.65) + num(0.4) * F.greatest(d_ndbi, num(0)) + num(0.3) * F.greatest(-d_ndvi, num(0)))),
        )
        .when(d_ndvi < -0.08, out("clearance", F.when(d_ndvi < -0.15, "disappearance").otherwise("contraction"), F.least(num(0.92), num(0.65) + num(0.5) * F.abs(d_ndvi))))
        .when((d_ndvi > 0.12) & (after_ndvi > 0.15), out("clearance", "expansion", F.least(num(0.92), num(0.65) + num(0.3) * F.least(d_ndvi, num(1)))))
        .when(((F.abs(d_ndwi) > 0.15) | (after_ndwi > 0.10)) & (d_ndvi < 0.20) & (after_ndbi <= 0.05), out("water_extent", grows, F.least(num(0.95), num(0.70) + F.abs(d_ndwi))))
        .otherwise(out("unclassified", F.when(d_ndbi > 0, "expansion").otherwise("contraction"), num(0.60)))
    )


def region_rationale(kind: Column, dynamics: Column, elongation: Column, d_ndvi: Column, d_ndwi: Column, d_ndbi: Column, after_ndbi: Column) -> Column:
    """One sentence on why a region has its type."""
    signed = lambda x: F.format_string("%+.2f", x)
    return (
        F.when(kind == "road_development", F.concat(F.lit("elongation "), F.format_string("%.2f", elongation), F.lit(" points to a linear corridor, "), dynamics))
        .when(kind == "construction", F.concat(F.lit("built-up index "), signed(d_ndbi), F.lit(" (after "), signed(after_ndbi), F.lit("), vegetation "), signed(d_ndvi)))
        .when(kind == "clearance", F.concat(F.lit("vegetation "), signed(d_ndvi), F.lit(", built-up after "), signed(after_ndbi)))
        .when(kind == "water_extent", F.concat(F.lit("water index "), signed(d_ndwi), F.lit(", "), dynamics))
        .otherwise(F.concat(F.lit("general shift: vegetation "), signed(d_ndvi), F.lit(", built-up "), signed(d_ndbi)))
    )


def suppressed(raw: Column, cloud_before: Column, cloud_after: Column, valid_before: Column, valid_after: Column, quality_before: Column, quality_after: Column, correlation: Column, radiometric: Column, series: Column, cloud_max: float = 0.35, threshold: float = 0.5) -> Column:
    """struct(change_score, quality_score, confidence, is_high_certainty, confounds) after the false-alarm penalties.

    series: other dates' raw scores, an array that may be null. Each confound is struct(factor, severity, penalty).
    """
    cloudy = (cloud_before > cloud_max) | (cloud_after > cloud_max)
    missing = (valid_before < 0.7) | (valid_after < 0.7)
    shifted, loose = correlation < 0.5, correlation < 0.7
    glare = radiometric > 0.6
    n = F.coalesce(F.size(series), F.lit(0))
    many = n >= 2
    persistent = F.size(F.filter(F.coalesce(series, F.array().cast("array<double>")), lambda v: v > threshold))
    kept = raw * F.when(cloudy, num(0.25)).otherwise(num(1)) * F.when(missing, num(0.5)).otherwise(num(1))
    kept = kept * F.when(shifted, num(0.3)).when(loose, num(0.75)).otherwise(num(1)) * F.when(glare, num(0.6)).otherwise(num(1))
    boosted = many & (persistent >= F.greatest(F.lit(2), n - 1))
    alone = many & (persistent == 0)
    score = F.when(boosted, F.least(num(1), kept + F.least(num(0.25), num(0.06) * persistent))).when(alone, kept * num(0.7)).otherwise(kept)
    score, worst = clip(score), F.least(quality_before, quality_after)
    confidence = clip(num(0.6) * score + num(0.4) * worst)

    def item(when: Column, factor: str, severity: Column | str, penalty: float) -> Column:
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(F.lit(factor).alias("factor"), severity.alias("severity"), num(penalty).alias("penalty")))

    found = F.filter(
        F.array(
            item(cloudy, "cloud_contamination", F.when(F.greatest(cloud_before, cloud_after) > 0.5, "high").otherwise("medium"), 0.25),
            item(missing, "missing_pixels", "medium", 0.5),
            item(shifted, "poor_registration", "high", 0.3),
            item(loose & ~shifted, "poor_registration", "low", 0.75),
            item(glare, "radiometric_shift", "medium", 0.6),
            item(alone, "insufficient_corroboration", "medium", 0.7),
            item(~many, "single_observation_pair", "low", 1.0),
        ),
        lambda x: x.isNotNull(),
    )
    sure = (confidence >= 0.75) & (F.size(F.filter(found, lambda x: x["severity"].isin("high", "medium"))) == 0)
    return F.struct(F.round(score, 4).alias("change_score"), F.round(worst, 4).alias("quality_score"), F.round(confidence, 4).alias("confidence"), sure.alias("is_high_certainty"), found.alias("confounds"))


def haversine_km(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), num(2)) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), num(2))
    a = F.least(a, num(1))
    return num(6371) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def compass(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    """The eighth of the compass in which the second point lies from the first."""
    d = F.radians(lon2 - lon)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat)) * F.cos(F.radians(lat2)) * F.cos(d)
    bearing = F.pmod(F.degrees(F.atan2(y, x)) + 360, num(360))
    return F.element_at(F.array(*[F.lit(p) for p in ("N", "NE", "E", "SE", "S", "SW", "W", "NW", "N")]), (F.floor((bearing + 22.5) / 45) + 1).cast("int"))


def place_line(name: Column, zone: Column, km: Column, direction: Column) -> Column:
    """A short line on where a point lies from its nearest landmark."""
    one = F.format_string("%.1f km ", km)
    return (
        F.when(km < 0.5, F.concat(name, F.lit(" ("), zone, F.lit(")")))
        .when(km < 3.5, F.concat(name, F.lit(" ("), one, direction, F.lit(")")))
        .when(km < 12.0, F.concat(name, F.lit(" Area ("), one, direction, F.lit(")")))
        .otherwise(F.concat(zone, F.format_string(" (%.0f km from ", km), name, F.lit(")")))
    )


def spectral_delta_score(mode: Column, d_ndvi: Column, d_ndwi: Column, d_ndbi: Column, before_mean: Column, after_mean: Column, n: Column, words: list[str]) -> Column:
    """The change proxy of a series from its first and last pass, by what the query's words ask for."""
    clear, build = bool({*words} & {*CLEAR_WORDS}), bool({*words} & {*BUILD_WORDS})
    up = lambda x, s: clip(F.greatest(num(0), x) / num(s))
    size = lambda x, s: clip(F.abs(x) / num(s))
    if clear:
        optical = num(0.75) * up(-d_ndvi, 0.18) + num(0.25) * size(d_ndbi, 0.15)
    elif build:
        optical = num(0.65) * up(d_ndbi, 0.15) + num(0.35) * up(-d_ndvi, 0.18)
    else:
        optical = F.greatest(size(d_ndbi, 0.15), size(d_ndvi, 0.18), size(d_ndwi, 0.18))
    change = (after_mean - before_mean) / F.greatest(F.abs(before_mean), num(1))
    radar = up(change, 0.25) if build else size(change, 0.30)
    support = F.least(num(1), num(0.8) + num(0.05) * F.greatest(F.lit(0), n - 2))
    return F.round(clip(F.when(mode == "optical", optical).otherwise(radar) * support), 4)


def dense_signal(mode: Column, feature: Column, spectral: Column, pixel: Column) -> Column:
    optical = num(0.55) * feature + num(0.30) * spectral + num(0.15) * pixel
    return F.least(num(1), F.when(mode == "sar", num(0.70) * feature + num(0.30) * pixel).otherwise(optical))


def area_hectares(pixels: Column, resolution: Column, places: int = 2) -> Column:
    r = or_default(resolution, 10.0)
    return F.round(pixels * r * r / num(10000), places)


def hidden_risk(d_cloud: Column, quality: Column) -> Column:
    """A word on the risk that a change is an artefact of clouds or shadows."""
    return F.when(d_cloud > 0.15, "elevated").when(quality > 0.75, "low").otherwise("moderate")


def slippy_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(num(2), zoom)).cast("int")


def slippy_y(lat: Column, zoom: Column) -> Column:
    # asinh is odd, and Spark's loses its digits for large negative numbers
    t = F.tan(F.radians(lat))
    return F.floor((1 - F.signum(t) * F.asinh(F.abs(t)) / num(3.141592653589793)) / 2 * F.pow(num(2), zoom)).cast("int")
