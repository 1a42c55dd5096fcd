"""Images as rows: pixels are packed once, and what follows moves an image's numbers and not its pixels one by one.

An image is bands (in order of their names), height, width and values, band by band and row by row; missing pixels are NaN.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import raster, registration

IMAGE = ("bands", "height", "width", "values")
_KINDS = "bands array<string>, height int, width int, values array<double>"


def _listed(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """One row that holds all of the values."""
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _unpacked(table: pa.Table, at: int = 0, suffix: str = "") -> tuple[list[str], np.ndarray]:
    """Bands and values (band, row, col) of one row."""
    one = lambda name: table.column(name + suffix)[at]
    bands = one("bands").as_py()
    return bands, one("values").values.to_numpy(zero_copy_only=False).reshape(len(bands), one("height").as_py(), one("width").as_py())


def _packed(bands: list[str], values: np.ndarray) -> dict[str, pa.Array]:
    return {"bands": pa.array([bands], pa.list_(pa.string())), "height": pa.array([values.shape[1]], pa.int32()), "width": pa.array([values.shape[2]], pa.int32()), "values": _listed(values)}


def packed(pixels: DataFrame, combined: bool = False) -> DataFrame:
    """tile_id and the image of each tile's pixels (tile_id, row, col, band, value), or of the means of its bands; a missing value or NaN is a missing pixel."""

    def run(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        coded = table.column("band").combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        bands = sorted(names)
        place = np.array([bands.index(n) for n in names])[coded.indices.to_numpy()]
        values = np.full((len(bands), int(row.max()) + 1, int(col.max()) + 1), np.nan)
        values[place, row, col] = table.column("value").to_numpy()
        if combined:
            lost = np.isnan(values).all(0)
            values = np.where(lost, np.nan, grey(bands, values, values.shape[1:]))[None]
            bands = ["grey"]
        return pa.table({"tile_id": table.column("tile_id").slice(0, 1), **_packed(bands, values)})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    rows = pixels.select("tile_id", "row", "col", "band", F.col("value").cast("double").alias("value"))
    return rows.groupBy("tile_id").applyInArrow(run, f"tile_id {kind}, {_KINDS}").hint("merge")


def medians(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the image of medians over their images, per pixel and band without missing ones."""

    def run(table: pa.Table) -> pa.Table:
        each = [_unpacked(table, i) for i in range(table.num_rows)]
        bands = sorted({b for names, _ in each for b in names})
        stack = np.full((len(each), len(bands), max(v.shape[1] for _, v in each), max(v.shape[2] for _, v in each)), np.nan)
        for at, (names, v) in zip(stack, each):
            at[[bands.index(b) for b in names], : v.shape[1], : v.shape[2]] = v
        with warnings.catch_warnings():
            # a pixel that all images lack
            warnings.simplefilter("ignore", RuntimeWarning)
            middle = np.nanmedian(stack, axis=0)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, **_packed(bands, middle)})

    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, *IMAGE).groupBy(*keys).applyInArrow(run, f"{kinds}, {_KINDS}").hint("merge")


def grey(names: list[str], bands: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The mean of the bands at each pixel, summed in the order of the model input; 0 where there is none."""
    order = sorted(range(len(names)), key=lambda i: (raster.MODEL_BANDS.index(names[i]) if names[i] in raster.MODEL_BANDS else len(raster.MODEL_BANDS), names[i]))
    known, total = ~np.isnan(bands), np.zeros(bands.shape[1:])
    for i in order:
        total += np.where(known[i], bands[i], 0)
    out = np.zeros(shape)
    out[: bands.shape[1], : bands.shape[2]] = total / np.maximum(known.sum(0), 1)
    return out


def _extent(image: np.ndarray) -> np.ndarray:
    """The image without rows and columns after the last ones that have a pixel."""
    r, c = np.nonzero(~np.isnan(image))
    return image[: r.max() + 1, : c.max() + 1] if len(r) else image[:0, :0]


def matched(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Values 0..1 of the source in the 8-bit levels of the target: for each level the one whose share of smaller-or-equal pixels is nearest (as `raster.histogram_match`)."""
    level = lambda v: np.clip(np.floor(v[~np.isnan(v)] * 255 + 0.5), 0, 255).astype(int)
    of, goal = level(source), np.bincount(level(target), minlength=256)
    if not len(of) or not goal.sum():
        return source
    count = np.bincount(of, minlength=256)
    share, points = np.cumsum(count) / count.sum(), np.flatnonzero(goal)
    at = (np.cumsum(goal) / goal.sum())[points]
    if points[0] > 0:
        points, at = np.concatenate([[0], points]), np.concatenate([[0.0], at])
    high = np.searchsorted(at, share, "right")
    low = high - 1
    gap = lambda i: np.abs(at[np.clip(i, 0, len(at) - 1)] - share)
    nearer = (low >= 0) & ((high == len(at)) | (gap(low) <= gap(high)))
    table = points[np.where(nearer, low, np.minimum(high, len(at) - 1))]
    out = source.copy()
    out[~np.isnan(source)] = table[of] / 255.0
    return out


def features(bands: np.ndarray, patch: int = raster.PATCH) -> tuple[np.ndarray, np.ndarray]:
    """Mean, spread and edge (patch row, patch column, band, 3) of each patch, and which bands it has (as `raster.patch_features`)."""
    n, h, w = bands.shape
    ph, pw = -(-h // patch), -(-w // patch)
    out, has = np.zeros((ph, pw, n, 3)), np.zeros((ph, pw, n), bool)
    for b, image in enumerate(bands):
        r, c = np.nonzero(~np.isnan(image))
        v, of = image[r, c], r // patch * pw + c // patch
        count = np.bincount(of, minlength=ph * pw)
        mean = np.bincount(of, v, ph * pw) / np.maximum(count, 1)
        spread = np.sqrt(np.bincount(of, (v - mean[of]) ** 2, ph * pw) / np.maximum(count, 1))
        edge = np.zeros(ph * pw)
        for along, across in ((c, r), (r, c)):
            order = np.lexsort((along, across)) if along is r else slice(None)
            step, here = np.abs(np.diff(v[order])), of[order]
            same = (here[1:] == here[:-1]) & (np.diff(across[order]) == 0)
            steps = np.bincount(here[1:][same], minlength=ph * pw)
            edge += np.bincount(here[1:][same], step[same], ph * pw) / np.maximum(steps, 1)
        out[:, :, b], has[:, :, b] = np.stack([mean, spread, edge], 1).reshape(ph, pw, 3), (count > 0).reshape(ph, pw)
    return out, has


def patch_vectors(images: DataFrame) -> DataFrame:
    """tile_id, pi, pj, _x (mean, spread and edge of each band, bands in order) and _x_bands of each patch."""

    def run(table: pa.Table) -> pa.Table:
        names, bands = _unpacked(table)
        x, has = features(bands)
        at = np.argwhere(has.any(2))
        made = [(x[i, j][has[i, j]].ravel().tolist(), [b for b, h in zip(names, has[i, j]) if h]) for i, j in at]
        key = pa.concat_arrays([table.column("tile_id").combine_chunks().slice(0, 1)] * len(at)) if len(at) else table.column("tile_id").slice(0, 0)
        return pa.table({"tile_id": key, "pi": pa.array(at[:, 0], pa.int32()), "pj": pa.array(at[:, 1], pa.int32()), "_x": pa.array([m[0] for m in made], pa.list_(pa.float64())), "_x_bands": pa.array([m[1] for m in made], pa.list_(pa.string()))})

    kind = images.schema["tile_id"].dataType.simpleString()
    return images.groupBy("tile_id").applyInArrow(run, f"tile_id {kind}, pi int, pj int, _x array<double>, _x_bands array<string>")


#: What `compared` says of a pair besides its pixels, in order.
_SAID = {"matrix": "array<double>", "inliers": "int", "correlation_before": "double", "correlation": "double", "is_aligned": "boolean", "dy": "double", "dx": "double", "raw": "double", "step": "double", "spread": "double", "_h": "int", "_w": "int", "_all": "long", "changed": "long"}

_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def _met(base: DataFrame, later: DataFrame, key: list[str]) -> GroupedData:
    """Each later image beside its base, a group a pair."""
    both = base.select(*key, *IMAGE).hint("merge").join(later.select(*key, "pair_id", *[F.col(c).alias(f"{c}_2") for c in IMAGE]).hint("merge"), key)
    return both.groupBy(*dict.fromkeys([*key, "pair_id"]))


def _pair(names_b: list[str], before: np.ndarray, names_a: list[str], after: np.ndarray, threshold: float | None) -> tuple[dict, dict[str, np.ndarray]]:
    """What is said of a pair, and its pixels: met, label, before_ and after_ of each band of the model input."""
    shape = (max(before.shape[1], after.shape[1]), max(before.shape[2], after.shape[2]))
    said = registration.registered(grey(names_b, before, shape), grey(names_a, after, shape))
    normal = {}
    for name, image in zip(names_a, after):
        image = _extent(image)
        if said["matrix"] is not None and image.size:
            image = registration.warped(image, np.array(said["matrix"]).reshape(2, 3))
        normal[name] = matched(image, before[names_b.index(name)]) if name in names_b else image
    h, w = max([v.shape[0] for v in normal.values()] or [0]), max([v.shape[1] for v in normal.values()] or [0])
    moved = np.full((len(names_a), h, w), np.nan)
    for at, name in zip(moved, names_a):
        at[: normal[name].shape[0], : normal[name].shape[1]] = normal[name]
    # a patch whose bands are not the same in both images has no distance
    (x, has_x), (y, has_y) = features(before), features(moved)
    every, grid = sorted({*names_b, *names_a}), (min(x.shape[0], y.shape[0]), min(x.shape[1], y.shape[1]))
    full_x, full_y = (np.zeros((*grid, len(every), 3)) for _ in range(2))
    got_x, got_y = (np.zeros((*grid, len(every)), bool) for _ in range(2))
    for full, got, names, v, has in ((full_x, got_x, names_b, x, has_x), (full_y, got_y, names_a, y, has_y)):
        at = [every.index(n) for n in names]
        got[:, :, at] = has[: grid[0], : grid[1]]
        full[:, :, at] = np.where(has[: grid[0], : grid[1], :, None], v[: grid[0], : grid[1]], 0)
    met = (got_x == got_y).all(2) & got_x.any(2)
    length = lambda v: np.sqrt((v**2).sum((2, 3)))
    d = np.clip(length(full_x - full_y) / (length(full_x) + length(full_y) + 1e-6), 0, 1)
    said["raw"] = float(d[met].mean()) if met.any() else None
    # pixels that both images have
    h, w = min(before.shape[1], h), min(before.shape[2], w)
    common = [n for n in names_b if n in names_a]
    b, a = before[[names_b.index(n) for n in common], :h, :w].copy(), moved[[names_a.index(n) for n in common], :h, :w].copy()
    lost = np.isnan(b) | np.isnan(a)
    b[lost] = a[lost] = np.nan
    said["_all"], said["changed"] = int((~np.isnan(before)).sum()), None
    r, c = np.nonzero((~lost).any(0))
    h, w = (int(r.max()) + 1, int(c.max()) + 1) if len(r) else (0, 0)
    said["_h"], said["_w"] = h, w
    said["step"] = said["spread"] = None
    pixels = {"met": (~lost[:, :h, :w]).sum(0).astype(np.int32), "label": np.zeros((h, w), np.int32)}
    if len(r):
        low, high = np.percentile(b[~lost], [5, 95])
        said["step"], said["spread"] = float(np.median(np.abs(a - b)[~lost])), float(high - low)
    if threshold is not None and len(r) and met.any():
        # the patch map at the size of the image, and what is over the threshold
        at = np.argwhere(met).max(0) + 1
        mask = raster.resized(np.where(met, d, 0)[: at[0], : at[1]], h, w) > threshold
        pixels["label"] = raster.label_components(mask).astype(np.int32)
        said["changed"] = int(mask.sum())
    for n in raster.MODEL_BANDS:
        for side, v in (("before", b), ("after", a)):
            pixels[f"{side}_{n}"] = v[common.index(n), :h, :w] if n in common else np.zeros(0)
    return said, pixels


def compared(base: DataFrame, later: DataFrame, key: list[str], threshold: float | None = None) -> DataFrame:
    """Registration, patch distances and aligned pixels of many image pairs: one row a pair.

    base: key and an image; later: key, pair_id and an image, which is moved by what registers it with the base's, if
    anything does, and whose bands are matched to the base's histograms. A row has pair_id, what `registration.registered` gives, raw (the
    mean distance of patches), step and spread (the median step between the pixels and the span of the base's), _h and _w, _all (pixels
    of the base), and arrays by pixel: met (bands that both have), before_ and after_ of each band and, given a threshold of distance,
    label, the components over it, with `changed`, their size. Images of one base lie together, so that they move once.
    """

    def run(table: pa.Table) -> pa.Table:
        said, pixels = _pair(*_unpacked(table), *_unpacked(table, 0, "_2"), threshold)
        out = {"pair_id": table.column("pair_id").slice(0, 1), **{n: pa.array([said[n]], _ARROW[k]) for n, k in _SAID.items()}}
        for n, v in pixels.items():
            flat = pa.array(v.ravel(), from_pandas=True)
            out[n] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.table(out)

    kind = later.schema["pair_id"].dataType.simpleString()
    names = ["met", "label", *[f"{side}_{n}" for n in raster.MODEL_BANDS for side in ("before", "after")]]
    kinds = ", ".join([f"pair_id {kind}", *[f"{n} {k}" for n, k in _SAID.items()], *[f"{n} array<{'int' if n in ('met', 'label') else 'double'}>" for n in names]])
    return _met(base, later, key).applyInArrow(run, kinds)


def registered(base: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """pair_id and what `registration.registered` gives for the means of bands, where both images have a pixel; base and later as for `compared`."""
    names = list(_SAID)[:7]

    def run(table: pa.Table) -> pa.Table:
        (names_b, before), (names_a, after) = _unpacked(table), _unpacked(table, 0, "_2")
        shape = (min(before.shape[1], after.shape[1]), min(before.shape[2], after.shape[2]))
        before, after = before[:, : shape[0], : shape[1]], after[:, : shape[0], : shape[1]]
        both = ~np.isnan(before).all(0) & ~np.isnan(after).all(0)
        said = registration.registered(grey(names_b, before, shape) * both, grey(names_a, after, shape) * both)
        return pa.table({"pair_id": table.column("pair_id").slice(0, 1), **{n: pa.array([said[n]], _ARROW[_SAID[n]]) for n in names}})

    kind = later.schema["pair_id"].dataType.simpleString()
    return _met(base, later, key).applyInArrow(run, ", ".join([f"pair_id {kind}", *[f"{n} {_SAID[n]}" for n in names]]))


def pixels_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row per pixel of `compared` (one without any for a pair that has none): keep, row, col, met, label, before_ and after_ of each band."""
    names = ["met", "label", *[f"{side}_{n}" for n in raster.MODEL_BANDS for side in ("before", "after")]]
    out = rows.select(*dict.fromkeys([*keep, "_w"]), F.posexplode_outer(F.arrays_zip(*names)).alias("_i", "_p"))
    at = [F.floor(F.col("_i") / F.col("_w")).cast("int").alias("row"), (F.col("_i") % F.col("_w")).cast("int").alias("col")]
    return out.select(*keep, *at, *[F.col(f"_p.{n}").alias(n) for n in names])
