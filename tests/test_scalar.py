import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from skyquilt.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_defaults(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (0.4,)], "a double").select(S.or_default(F.col("a"), 0.8).alias("x")).collect()
    assert [r["x"] for r in rows] == [0.8, 0.8, 0.4]


def test_ids(spark):
    assert one(spark, S.point_id(F.lit("tile-1"))) == int(hashlib.md5(b"tile-1").hexdigest()[:15], 16)
    assert one(spark, S.uuid5(F.lit("a/b"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b"))


def test_sensor_names():
    assert "Sentinel-2 MSI" in S.sensor_names("sentinel2") and "SAR-C" in S.sensor_names("s1")
    assert S.sensor_names("Cartosat-3") == sorted({"Cartosat-3", "cartosat-3", "CARTOSAT-3"})


def test_change_words(spark):
    assert one(spark, S.change_words(F.lit("new construction near Sector 5"))) == ["construction", "new"]
    assert one(spark, S.change_words(F.lit("renewable energy site"))) == []


def test_change_ranks_over_stable(spark):
    score = lambda change: one(spark, S.final_score(S.num(0.8), S.num(0.8), S.num(1), S.num(1), S.num(change), True, True))
    assert score(0.9) > score(0.0)
    assert score(0.9) == pytest.approx(0.45 * 0.8 + 0.35 * 0.9 + 0.1 * 0.8 + 0.1, abs=1e-4)


def test_spectral_pair(spark):
    s = S.spectral_delta_score(F.lit("optical"), S.num(0.08 - 0.35), S.num(-0.04), S.num(0.18), S.num(0), S.num(0), F.lit(2), ["construction", "new"])
    assert one(spark, s) >= 0.75


CASES = {
    "clean": ((0.85, 0.02, 0.03, 0.98, 0.97, 0.95, 0.93, 0.95, 0.05, [0.80, 0.82, 0.78]), set()),
    "cloudy": ((0.80, 0.60, 0.05, 0.9, 0.95, 0.70, 0.90, 0.90, 0.10, None), {"cloud_contamination", "single_observation_pair"}),
    "shifted": ((0.75, 0.02, 0.03, 0.98, 0.97, 0.9, 0.9, 0.30, 0.05, None), {"poor_registration", "single_observation_pair"}),
    "radiometric": ((0.70, 0.02, 0.03, 0.98, 0.97, 0.9, 0.9, 0.90, 0.80, None), {"radiometric_shift", "single_observation_pair"}),
    "alone": ((0.65, 0.02, 0.03, 0.98, 0.97, 0.9, 0.9, 0.90, 0.05, [0.10, 0.08, 0.12]), {"insufficient_corroboration"}),
}


@pytest.mark.parametrize("name", CASES)
def test_suppression(spark, name):
    values, factors = CASES[name]
    series = F.array(*[F.lit(v) for v in values[-1]]) if values[-1] else F.lit(None).cast("array<double>")
    out = one(spark, S.suppressed(*[S.num(v) for v in values[:-1]], series))
    assert {c["factor"] for c in out["confounds"]} == factors
    assert (out["confidence"] >= 0.7 and out["is_high_certainty"]) == (name == "clean")


def test_region_types(spark):
    kind = lambda **k: one(spark, S.region_type(*[S.num(k.get(n, 0.0)) for n in ("el", "asp", "sol", "dv", "dw", "db", "bb", "ab", "aw", "av")]))
    assert kind(el=1.0, asp=1, sol=1, dv=-0.65, db=0.8, bb=-0.4, ab=0.4)["change_type"] == "construction"
    assert kind(el=1.0, asp=1, sol=1, dv=-0.65, db=0.05, bb=-0.3, ab=-0.25)["change_type"] == "clearance"
    assert kind(el=1.2, asp=1, sol=1, dw=0.95, aw=0.65, ab=-0.2, db=-0.1)["change_type"] == "water_extent"
    assert kind(el=15.0, asp=15, sol=1, dv=-0.35, db=0.55, ab=0.35)["change_type"] == "road_development"


def test_geo(spark):
    assert one(spark, S.geo_relevance(S.num(0.001), S.num(0.0))) == 1.0
    assert one(spark, S.geo_relevance(S.num(1.0), S.num(0.0))) is None
    assert one(spark, S.compass(S.num(88.0), S.num(22.0), S.num(88.0), S.num(23.0))) == "N"
    assert one(spark, S.haversine_km(S.num(0), S.num(0), S.num(0), S.num(1))) == pytest.approx(111.19, abs=0.01)


def test_times(spark):
    assert str(one(spark, S.parsed_time(F.lit("2024-01-05T10:00:00Z")))) == "2024-01-05 10:00:00"
    assert str(one(spark, S.parsed_time(F.lit("20240105")))) == "2024-01-05 00:00:00"
    assert one(spark, S.parsed_time(F.lit("no"))) is None
