"""File sources: scene discovery, names, band maps, provenance sidecars and tile caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys of a provenance record, its portals and its datasets.
REQUIRED = ("source_portal", "underlying_dataset", "satellite", "sensor", "acquisition_date", "resolution_m", "bounding_box", "license", "download_date", "ps_named_source")
PORTALS = ("Bhoonidhi", "Bhuvan", "Copernicus Data Space Ecosystem", "Google Earth Engine", "USGS EarthExplorer")
DATASETS = ("Sentinel-2 L2A", "Sentinel-1 GRD", "Landsat 8/9 C2L2", "AWiFS", "LISS-III", "LISS-IV", "Cartosat-2S")
#: Band numbers (from 1) by what a sensor's name holds, in order of trial; those by the count of bands; the bands that descriptions may name.
SENTINEL = {"blue": 1, "green": 2, "red": 3, "nir": 4, "swir1": 5, "swir2": 6, "scl": 7}
LANDSAT = {"blue": 2, "green": 3, "red": 4, "nir": 5, "swir1": 6}
BANDS = (("sentinel-2", SENTINEL), ("sentinel2", SENTINEL), ("landsat-8", LANDSAT), ("landsat", LANDSAT), ("rgb", {"red": 1, "green": 2, "blue": 3}), ("bgr", {"blue": 1, "green": 2, "red": 3}))
BY_COUNT = {7: SENTINEL, 6: {"blue": 1, "green": 2, "red": 3, "nir": 4, "swir1": 5, "swir2": 6}, 4: {"blue": 1, "green": 2, "red": 3, "nir": 4}, 3: {"red": 1, "green": 2, "blue": 3}, 2: {"red": 1, "green": 2, "blue": 2}, 1: {"red": 1, "green": 1, "blue": 1}}
DESCRIBED = ("blue", "green", "red", "nir", "swir1", "swir2", "scl")
#: Tags that name a scene's sensor and its date, in order of trial, and the forms of the date.
SENSOR_TAGS, DATE_TAGS = ("SENSOR", "SATELLITE", "PLATFORM"), ("ACQUISITION_DATE", "TIFFTAG_DATETIME", "DATETIME")
DATE_FORMS = ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}", "yyyy:MM:dd HH:mm:ss"), (r"\d{8}", "yyyyMMdd"), (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"))

PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_portal", "underlying_dataset", "satellite", "sensor", "acquisition_date", "license", "download_date", "ps_named_source", "notes")] + [T.StructField("resolution_m", T.DoubleType()), T.StructField("cloud_cover_pct", T.DoubleType()), T.StructField("bounding_box", T.ArrayType(T.DoubleType()))])


def scene_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of all .tif and .tiff files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff}").load(folder)


def band_map(tag: Column, sensor: Column, bands: Column, descriptions: Column | None = None) -> Column:
    """Band name to number, from 1: from a BAND_NAMES tag, else from three or more bands that their descriptions name, else the sensor's if the scene has as many bands, else by their count."""

    def mapped(numbers: dict[str, int]) -> Column:
        return F.create_map(*[x for n, i in numbers.items() for x in (F.lit(n), F.lit(i))])

    # of a repeated name the last band counts
    def last_of(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.array_max(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["at"]))))

    number = lambda parts: F.transform(parts, lambda n, i: F.struct(F.lower(F.trim(n)).alias("name"), (i + 1).alias("at")))
    out = F.when(F.coalesce(tag, F.lit("")) != "", last_of(number(F.split(tag, ","))))
    if descriptions is not None:
        found = F.flatten(F.transform(number(descriptions), lambda d: F.transform(F.filter(F.array(*[F.lit(k) for k in DESCRIBED]), lambda k: F.contains(d["name"], k)), lambda k: F.struct(k.alias("name"), d["at"].alias("at")))))
        out = out.when(F.size(F.array_distinct(F.transform(found, lambda p: p["name"]))) >= 3, last_of(found))
    plain = F.regexp_replace(F.regexp_replace(F.lower(sensor), " ", ""), "_", "-")
    for key, numbers in BANDS:
        out = out.when(plain.contains(key) & (bands >= max(numbers.values())), mapped(numbers))
    for least, numbers in BY_COUNT.items():
        out = out.when(bands >= least, mapped(numbers))
    return out


def name_parts(name: Column, tags: Column | None = None) -> tuple[Column, Column]:
    """Sensor and date: from a map of tags, else the file name's part before the first underscore and its first part that is a date of eight digits."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    days = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{8}$")), lambda p: F.try_to_timestamp(p, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    sensor, day = parts[0], F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))
    if tags is not None:
        of = lambda names: F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names])
        text = F.substring(of(DATE_TAGS), 1, 19)
        dated = F.coalesce(*[F.when(text.rlike(f"^{pattern}$"), F.try_to_timestamp(text, F.lit(form))) for pattern, form in DATE_FORMS])
        sensor, day = F.coalesce(of(SENSOR_TAGS), sensor), F.coalesce(dated.cast("timestamp_ntz"), day)
    return F.coalesce(sensor, F.lit("unknown")), day


def provenance_errors(record: Column, strict: bool = False, portals: tuple[str, ...] = PORTALS, datasets: tuple[str, ...] = DATASETS) -> Column:
    """What is wrong with a provenance record, as an array of texts; none if it is valid."""
    f = lambda n: record[n]
    day = lambda n: F.when(f(n).isNotNull() & (~f(n).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | F.try_to_timestamp(f(n), F.lit("yyyy-M-d")).isNull()), F.lit(f"{n} is not a day"))
    checks = [
        *[F.when(f(n).isNull(), F.lit(f"missing {n}")) for n in REQUIRED],
        F.when(~f("source_portal").isin(*portals), F.lit("unknown source_portal")),
        F.when(~f("underlying_dataset").isin(*datasets), F.lit("unknown underlying_dataset")),
        day("acquisition_date"),
        day("download_date"),
        F.when(f("resolution_m") <= 0, F.lit("bad resolution_m")),
        F.when(F.size(f("bounding_box")) != 4, F.lit("bad bounding_box")),
    ]
    if strict:
        box = f("bounding_box")
        checks += [
            F.when((F.get(box, F.lit(0)) < -180) | (F.get(box, F.lit(2)) > 180) | (F.get(box, F.lit(1)) < -90) | (F.get(box, F.lit(3)) > 90), F.lit("bounding_box out of range")),
            F.when((f("cloud_cover_pct") < 0) | (f("cloud_cover_pct") > 100), F.lit("bad cloud_cover_pct")),
            *[F.when(F.trim(f(n)) == "", F.lit(f"empty {n}")) for n in ("source_portal", "underlying_dataset", "satellite", "sensor", "license")],
        ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files as one struct column, with their errors."""
    rows = spark.read.schema(PROVENANCE).option("multiLine", True).json(path)
    return rows.select(F.struct(*rows.columns).alias("provenance")).withColumn("errors", provenance_errors(F.col("provenance")))


def provenance_line(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json("provenance").alias("value"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """name, kind and geometry of a feature collection's features."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select(F.lower(F.trim("f.properties.name")).alias("name"), F.col("f.geometry").alias("geometry"))


def synthetic_scene(spark: SparkSession, side: int = 64, dates: int = 8) -> DataFrame:
    """A small made-up scene stack in long form: a field, a settlement that grows, a road and clouds on two dates."""
    n = spark.range(side * side * dates)
    rows = n.select((F.col("id") / (side * side)).cast("int").alias("pass_no"), ((F.col("id") / side) % side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    grown = (F.col("row") < side // 3 + F.col("pass_no")) & (F.col("col") < side // 3)
    noise = F.pmod(F.xxhash64("pass_no", "row", "col"), F.lit(1000)) / 20000.0
    band = lambda field, built: F.when(grown, F.lit(built)).otherwise(F.lit(field)) + noise
    cloud = F.col("pass_no").isin(2, 6) & (F.col("row") >= side // 2)
    over = lambda c: F.when(cloud, F.lit(0.92)).otherwise(c)
    return rows.select("*", over(band(0.08, 0.25)).alias("blue"), over(band(0.10, 0.25)).alias("green"), over(band(0.08, 0.28)).alias("red"), over(band(0.45, 0.30)).alias("nir"), over(band(0.20, 0.40)).alias("swir1"))
