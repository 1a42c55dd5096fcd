"""Quality masks of tiles against NumPy, and their odd cases."""

import numpy as np
import pytest

from skyquilt.operators import raster
from skyquilt.plans import ingest

DDL = "tile_id int, row int, col int, band string, value double, sensor string"


def long(tile, bands, sensor):
    return [(tile, r, c, b, float(v), sensor) for b, a in bands.items() for (r, c), v in np.ndenumerate(a)]


def by_numpy(bands, sensor):
    """clear, valid_share, confounds, speckle of one tile with bands in order of name."""
    cube = np.stack([bands[b] for b in sorted(bands)])
    valid = np.isfinite(cube).all(0) & ~(cube == 0).all(0)
    if "SAR" in sensor:
        echo = np.abs(cube[0])
        seen = np.isfinite(echo) & (echo != 0)
        cv = echo[seen].std() / (echo[seen].mean() + 1e-6) if seen.any() else 0.0
        return (valid & seen).mean(), valid.mean(), ["speckle"] if 1 - cv / 2 < 0.25 else [], round(cv, 5)
    if "scl" in bands:
        names = {0: "nodata", 1: "saturated", 2: "dark", 3: "cloud_shadow", 8: "cloud_medium", 9: "cloud_high", 10: "cirrus", 11: "snow"}
        return (valid & np.isin(bands["scl"], [4, 5, 6, 7])).mean(), valid.mean(), sorted({names[int(v)] for v in np.unique(bands["scl"]) if v in names}), None
    rgb = np.stack([bands[b] for b in ("red", "green", "blue")])
    cloud = (rgb.mean(0) > 0.75) & ((rgb.max(0) - rgb.min(0)) / (rgb.max(0) + 1e-6) < 0.15)
    return (valid & ~cloud).mean(), valid.mean(), ["cloud_haze"] if cloud.any() else [], None


def scenes():
    rng = np.random.default_rng(5)
    level = lambda: rng.random((12, 9)) * (rng.random((12, 9)) > 0.2)
    out = {}
    for k in range(12):
        bands = {b: level() for b in ("blue", "green", "red")}
        if k % 3 == 0:
            bands = {"vh": rng.exponential(0.2, (12, 9)) ** (1 + 3 * (k % 2)), "vv": level()}
        elif k % 3 == 1:
            bands["scl"] = rng.integers(k // 3, 12, (12, 9)).astype(float)
        else:
            for b in bands:
                bands[b][:6] = 0.8 + 0.01 * (k % 2)
                bands[b][-2:] = 0
        bands["vv" if k % 3 == 0 else "red"][0, 0] = np.nan
        out[k] = (bands, "SAR-C" if k % 3 == 0 else "MSI")
    return out


def test_masks_equal_numpy(spark):
    made = scenes()
    _, masks = raster.quality_masks(spark.createDataFrame([x for k, (b, s) in made.items() for x in long(k, b, s)], DDL))
    got = {r["tile_id"]: r for r in masks.collect()}
    assert set(got) == set(made)
    for k, (bands, sensor) in made.items():
        clear, share, confounds, speckle = by_numpy(bands, sensor)
        r = got[k]
        assert (round(r["clear"], 9), round(r["valid_share"], 9), r["confounds"]) == (round(clear, 9), round(share, 9), confounds)
        assert r["speckle"] is None if speckle is None else r["speckle"] == pytest.approx(speckle, abs=2e-5)
    assert {r["method"] for r in got.values()} == {"speckle", "scl", "brightness_saturation"}
    assert any(r["confounds"] == ["speckle"] for r in got.values()) and any(r["confounds"] == [] for r in got.values())


def test_sharpness_and_gates(spark):
    made = scenes()
    cloudy = {b: np.full((8, 8), 0.9) for b in ("blue", "green", "red")}
    empty = {b: np.zeros((8, 8)) for b in ("blue", "green", "red")}
    made |= {20: (cloudy, "MSI"), 21: (empty, "MSI")}
    got = {r["tile_id"]: r for r in ingest.judged(spark.createDataFrame([x for k, (b, s) in made.items() for x in long(k, b, s) if x[4] == x[4]], DDL)).collect()}
    assert got[20]["discard_reasons"] == ["cloud_haze"] and got[21]["discard_reasons"] == ["low_clear_fraction"] and got[1]["discard_reasons"] is None
    bands = made[2][0]
    grey = np.nan_to_num(np.stack([bands[b] for b in ("red", "green", "blue")])).sum(0) / 3
    gy, gx = np.gradient(grey)
    want = min(1.0, (np.gradient(gx, axis=1) + np.gradient(gy, axis=0)).var() / 0.02)
    assert got[2]["sharpness"] == pytest.approx(want, abs=1e-6)
    assert got[2]["quality"] == pytest.approx(0.45 * got[2]["clear"] + 0.35 * got[2]["valid_share"] + 0.2 * got[2]["sharpness"], abs=1e-6)
    # radar has no light to be sharp in
    assert got[0]["sharpness"] is None and got[0]["quality"] is not None


def test_odd_pixels(spark):
    """Nulls, infinities, values of nodata, missing bands and sensors, and an empty table."""
    rows = [(1, 0, 0, "red", None, None), (1, 0, 1, "red", float("inf"), None), (1, 1, 0, "red", -9.0, None), (1, 1, 1, "red", 0.5, None), (2, 0, 0, "scl", None, "MSI")]
    mask, said = raster.quality_masks(spark.createDataFrame(rows, DDL), nodata=-9.0)
    assert {(r["row"], r["col"]): r["usable"] for r in mask.where("tile_id = 1").collect()} == {(0, 0): False, (0, 1): False, (1, 0): False, (1, 1): True}
    assert {r["tile_id"]: (r["modality"], r["clear"], r["confounds"]) for r in said.collect()} == {1: ("optical", 0.25, []), 2: ("optical", 0.0, [])}
    assert ingest.judged(spark.createDataFrame([], DDL)).count() == 0
