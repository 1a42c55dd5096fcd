"""Images as rows say what the operators on single pixels say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt import catalog
from skyquilt.operators import images, raster

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pixels(spark):
    """Two images of two bands, of which pixels and patches are missing."""
    rng = np.random.default_rng(8)
    rows = [(t, r, c, b, float(rng.uniform(0, 1)), rng.uniform()) for t in (1, 2) for b in ("red", "nir") for r in range(35) for c in range(40) if not (t == 2 and b == "nir" and r >= 32)]
    return spark.createDataFrame([row[:5] for row in rows if row[5] < 0.8], "tile_id long, row int, col int, band string, value double").cache()


def test_features_and_levels_as_of_single_pixels(spark, pixels):
    whole = images.packed(pixels)
    got = {(r["tile_id"], r["pi"], r["pj"]): (r["_x_bands"], r["_x"]) for r in images.patch_vectors(whole).collect()}
    want = {}
    for r in raster.patch_features(pixels).orderBy("band").collect():
        names, x = want.setdefault((r["tile_id"], r["pi"], r["pj"]), ([], []))
        names.append(r["band"])
        x += [r["mean"], r["std"], r["edge"]]
    assert got.keys() == want.keys() and any(len(names) == 1 for names, _ in got.values())
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1], atol=1e-12) for k in want)
    one, two = ({r["tile_id"]: np.array(r["values"]).reshape(2, r["height"], r["width"])[1] for r in whole.collect()}[t] for t in (1, 2))
    table = {r["value"]: r["matched"] for r in raster.histogram_match(*(pixels.where(f"tile_id = {t} and band = 'red'") for t in (2, 1))).collect()}
    moved = images.matched(two, one)
    at = np.argwhere(~np.isnan(two))
    assert all(moved[r, c] == table[int(np.floor(two[r, c] * 255 + 0.5))] / 255.0 for r, c in at) and np.isnan(moved).sum() == np.isnan(two).sum()
    middle = images.medians(whole.withColumn("k", F.lit(1)), ["k"]).collect()[0]
    want = {(r["band"], r["row"], r["col"]): r["value"] for r in raster.median_baseline(pixels.withColumn("series_id", F.lit(1))).collect()}
    values = np.array(middle["values"]).reshape(2, 35, 40)
    assert middle["bands"] == ["nir", "red"] and (~np.isnan(values)).sum() == len(want) and all(abs(values[middle["bands"].index(b), r, c] - v) < 1e-15 for (b, r, c), v in want.items())


@pytest.mark.parametrize("name", ["dense_change", "bitemporal_change", "registration"])
def test_pixels_are_not_shuffled_one_by_one(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("row#" in line or "col#" in line)]


def test_made_pixels_share_what_bands_have_in_common(spark):
    from skyquilt import views

    # one hash for the noise, two for the field: not again for each band and surface
    plan = views.scene_pixels(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") <= 6
