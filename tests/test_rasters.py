import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import projection as P
from skyquilt.operators import index, vector
from skyquilt.plans import ingest, search
from skyquilt.sources import rasters as R


def lzw(data):
    """Codes from the high bits on, as TIFF has them."""
    out, held, n = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code):
        nonlocal held, n
        held, n = (held << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append((held >> n) & 255)

    put(256)
    size, w = 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c], size, w = size, size + 1, c
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    if w:
        put(table[w])
        width = 9 if size + 1 < 512 else 10 if size + 1 < 1024 else 11 if size + 1 < 2048 else 12
    put(257)
    if n:
        out.append((held << (8 - n)) & 255)
    return bytes(out)


def tiff(bands, end="<", compression=1, tile=None, rows=None, planar=1, predictor=1, geo=None, nodata=None, stamp=None):
    """A TIFF file of (bands, h, w)."""
    count, h, w = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100))}[compression]
    chunks, size = [], bands.dtype.itemsize

    def packed(part):
        """(rows, columns, samples)"""
        if predictor == 2:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
        if predictor == 3:
            big = np.ascontiguousarray(part.reshape(part.shape[0], -1)).astype(f">f{size}").view(np.uint8).reshape(part.shape[0], -1, size)
            line = big.transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
            return pack(np.concatenate([line[:, :1], line[:, 1:] - line[:, :-1]], axis=1).tobytes())
        return pack(part.astype(bands.dtype.newbyteorder(end)).tobytes())

    for plane in bands[:, None] if planar == 2 else [bands]:
        whole = plane.transpose(1, 2, 0)
        if tile:
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    part = np.zeros((tile, tile, whole.shape[2]), bands.dtype)
                    piece = whole[r : r + tile, c : c + tile]
                    part[: piece.shape[0], : piece.shape[1]] = piece
                    chunks.append(packed(part))
        else:
            chunks += [packed(whole[r : r + (rows or h)]) for r in range(0, h, rows or h)]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * size] * count), 259: ("H", [compression]), 277: ("H", [count]), 284: ("H", [planar]), 317: ("H", [predictor]), 339: ("H", [kind] * count)}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", None), 325: ("I", [len(c) for c in chunks])} if tile else {278: ("I", [rows or h]), 273: ("I", None), 279: ("I", [len(c) for c in chunks])}
    for tag, text in ((306, stamp), (42113, nodata)):
        if text:
            tags[tag] = ("s", text.encode() + b"\0")
    if geo:
        scale, tie, epsg = geo
        tags |= {33550: ("d", scale), 33922: ("d", tie), 34735: ("H", [1, 1, 0, 1, 3072 if epsg > 30000 else 2048, 0, 1, epsg])}
    at, places = 8, []
    for c in chunks:
        places.append(at)
        at += len(c)
    body, start, entries, extra = b"".join(chunks), at, [], b""
    extra_at = start + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        code, values = tags[tag]
        values = places if values is None else values
        data = values if code == "s" else struct.pack(end + code * len(values), *values)
        number = {"H": 3, "I": 4, "d": 12, "s": 2}[code]
        if len(data) <= 4:
            value = data.ljust(4, b"\0")
        else:
            value, extra = struct.pack(end + "I", extra_at + len(extra)), extra + data
        entries.append(struct.pack(end + "HHI", tag, number, len(values)) + value)
    return (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, start) + body + struct.pack(end + "H", len(tags)) + b"".join(entries) + b"\0" * 4 + extra


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("shape", [dict(), dict(rows=7), dict(tile=16), dict(tile=16, planar=2), dict(rows=5, planar=2), dict(rows=9, predictor=2), dict(tile=32, predictor=2)])
def test_tiffs_of_many_kinds(compression, end, shape):
    rng = np.random.default_rng(1)
    for dtype in (np.uint8, np.uint16, np.int16):
        bands = np.cumsum(rng.integers(0, 9, (4, 40, 50)), axis=2).astype(dtype)
        t = R.Tiff(tiff(bands, end, compression, **shape))
        assert (t.height, t.width, t.bands) == (40, 50, 4) and (t.read() == bands).all()
        for r, c, h, w in ((0, 0, 5, 5), (13, 30, 20, 20), (39, 49, 1, 1)):
            assert (t.read(r, c, h, w) == bands[:, r : r + h, c : c + w]).all()


@pytest.mark.parametrize("predictor", [1, 3])
def test_float_tiffs(predictor):
    bands = np.random.default_rng(2).normal(size=(2, 33, 21)).astype(np.float32)
    t = R.Tiff(tiff(bands, "<", 8, rows=10, predictor=predictor, nodata="-9999", geo=([10, 10, 0], [0, 0, 0, 600000, 2500000, 0], 32645), stamp="2024:01:02 03:04:05"))
    assert (t.read() == bands).all() and t.nodata == -9999 and t.epsg == 32645 and t.transform == [600000, 10, 0, 2500000, 0, -10] and t.text(306) == "2024:01:02 03:04:05"


def test_long_lzw():
    data = np.random.default_rng(3).integers(0, 5, 40000).astype(np.uint8).tobytes()
    assert R.unpacked_lzw(lzw(data)) == data


def png(image, filters=(0, 1, 2, 3, 4), palette=None):
    h, w, ch = image.shape
    step = ch * image.dtype.itemsize
    raw = image.astype(image.dtype.newbyteorder(">")).tobytes()
    lines = np.frombuffer(raw, np.uint8).reshape(h, w * step).astype(int)
    out = b""
    for r in range(h):
        kind, line, up = filters[r % len(filters)], lines[r], lines[r - 1] if r else np.zeros(w * step, int)
        left, corner = np.r_[np.zeros(step, int), line[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    color = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[ch]

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    packed = zlib.compress(out)
    return R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, image.dtype.itemsize * 8, color, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:50]) + chunk(b"IDAT", packed[50:]) + chunk(b"IEND", b"")


def test_pngs():
    rng = np.random.default_rng(4)
    for ch in (1, 2, 3, 4):
        image = rng.integers(0, 256, (23, 17, ch)).astype(np.uint8)
        assert (R.png(png(image)) == image).all()
    deep = rng.integers(0, 65536, (9, 8, 3)).astype(np.uint16)
    assert (R.png(png(deep)) == deep).all() and (R.rgb(png(deep)) == deep >> 8).all()
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    numbers = rng.integers(0, 256, (6, 5, 1)).astype(np.uint8)
    assert (R.rgb(png(numbers, palette=palette)) == palette[numbers[..., 0]]).all()


def test_uploaded_images():
    flat = np.broadcast_to(np.array([255, 128, 64], np.uint8), (100, 100, 3))
    assert (R.rgb(png(flat)) == flat).all()
    four = np.random.default_rng(5).integers(200, 4000, (4, 128, 128)).astype(np.uint16)
    assert R.rgb(tiff(four)).shape == (128, 128, 3) and R.rgb(tiff(four)).dtype == np.uint8
    one = np.random.default_rng(6).integers(0, 255, (1, 64, 64)).astype(np.uint8)
    grey = R.rgb(tiff(one))
    assert grey.shape == (64, 64, 3) and (grey[..., 0] == grey[..., 2]).all()
    plain = np.random.default_rng(7).integers(0, 255, (3, 16, 16)).astype(np.uint8)
    assert (R.rgb(tiff(plain)) == plain.transpose(1, 2, 0)).all()
    with pytest.raises(ValueError, match="empty"):
        R.rgb(b"")
    for broken in (b"NOT_AN_IMAGE_CONTENT_XYZ", tiff(one)[:40], R.PNG, png(flat)[:60]):
        with pytest.raises(ValueError, match="unable to identify or decode"):
            R.rgb(broken)


def test_scenes_and_windows(spark, tmp_path):
    bands = np.random.default_rng(8).integers(0, 3000, (3, 70, 100)).astype(np.uint16)
    bands[:, 0, 0] = 7
    (tmp_path / "a.tif").write_bytes(tiff(bands, compression=8, tile=16, nodata="7", geo=([10, 10, 0], [0, 0, 0, 600000, 2500000, 0], 32645)))
    (tmp_path / "b.tiff").write_bytes(tiff(bands[:1], geo=([0.001, 0.001, 0], [0, 0, 0, 88, 22, 0], 4326)))
    (tmp_path / "c.tif").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in R.scenes(files).collect()}
    assert rows["c.tif"]["error"] and rows["c.tif"]["height"] is None
    assert (rows["a.tif"]["height"], rows["a.tif"]["width"], rows["a.tif"]["bands"], rows["a.tif"]["epsg"], rows["a.tif"]["nodata"]) == (70, 100, 3, 32645, 7.0)
    got = R.windows(files, 32).where("path like '%a.tif'").collect()
    # six whole windows, and no fragment of 6 rows or 4 columns
    assert {(r["row_off"], r["col_off"], r["h"], r["w"]) for r in got} == {(r, c, 32, 32) for r in (0, 32) for c in (0, 32, 64)} and len(got) == 18
    for r in got:
        want = bands[r["band"] - 1, r["row_off"] : r["row_off"] + 32, r["col_off"] : r["col_off"] + 32].ravel().astype(float).tolist()
        assert r["pixels"] == [None if v == 7 else v for v in want]
    at = {(r["path"].rsplit("/", 1)[1], r["row_off"], r["col_off"]): r for r in R.placed(R.scenes(files), 32).collect()}
    b = at["b.tiff", 0, 32]
    assert abs(b["minx"] - 88.032) < 1e-9 and abs(b["maxy"] - 22) < 1e-9 and abs(b["lat"] - 21.984) < 1e-9
    a = at["a.tif", 0, 0]
    assert 87.9 < a["minx"] < a["maxx"] < 88.1 and 22.5 < a["miny"] < a["maxy"] < 22.7


def test_ingestion_counts_a_file_once(spark, tmp_path):
    bands = np.random.default_rng(11).integers(0, 3000, (4, 96, 160)).astype(np.uint16)
    inside, outside = ([0.001, 0.001, 0], [0, 0, 0, 88.1, 22.5, 0], 4326), ([0.001, 0.001, 0], [0, 0, 0, 10.0, 10.0, 0], 4326)
    (tmp_path / "S2A_20240102_a.tif").write_bytes(tiff(bands, compression=8, geo=inside))
    (tmp_path / "S2A_20240102_copy.tif").write_bytes(tiff(bands, compression=8, geo=inside))
    (tmp_path / "L8_x.tif").write_bytes(tiff(bands + 1, geo=outside, stamp="2023:05:06 07:08:09"))
    (tmp_path / "bad_20240101.tif").write_bytes(b"broken")
    paths = spark.read.format("binaryFile").load(str(tmp_path))
    none = spark.createDataFrame([], "source_hash string, scene_id string, status string"), spark.createDataFrame([], "tile_uuid string"), spark.createDataFrame([], "scene_id string")
    scenes, tiles, pixels, repair = ingest.ingested(paths, *none, size=64)
    rows = scenes.collect()
    assert len(rows) == 3 and {(r["sensor"], str(r["ts"])[:10], r["status"]) for r in rows} == {("S2A", "2024-01-02", "ingested"), ("L8", "2023-05-06", "ingested"), ("bad", "2024-01-01", "failed")}
    # windows of 64 x 64 and halves, of the scene in the area only
    assert {(r["row_off"], r["col_off"], r["h"], r["w"]) for r in tiles.collect()} == {(r, c, min(64, 96 - r), min(64, 160 - c)) for r in (0, 64) for c in (0, 64, 128)}
    got = pixels.collect()
    assert len(got) == 24 and all(r["pixels"] == bands[r["band"] - 1, r["row_off"] : r["row_off"] + r["h"], r["col_off"] : r["col_off"] + r["w"]].ravel().astype(float).tolist() for r in got)
    assert repair.count() == 0
    known = scenes.select("source_hash", F.col("source_hash").alias("scene_id"), "status")
    again, more, _, repair = ingest.ingested(paths, known, tiles.select("tile_uuid"), tiles.select(F.col("source_hash").alias("scene_id")), size=64)
    # the broken file is tried again, and the scene without tiles has no vectors
    assert [r["status"] for r in again.collect()] == ["failed"] and more.count() == 0 and repair.count() == 1
    # tiles that are known are not made twice, even if the scene is
    _, rest, _, _ = ingest.ingested(paths, none[0], tiles.select("tile_uuid"), none[2], size=64)
    assert rest.count() == 0


def test_utm(spark):
    known = [(-79.387139, 43.642567, 17, 630084, 4833438, 1.0), (2.2945, 48.8582, 31, 448252, 5411933, 1.5), (3.0, 0.0, 31, 500000, 0, 1e-6), (0.0, 0.0, 31, 166021.443, 0, 1e-3), (6.0, 0.0, 31, 833978.557, 0, 1e-3)]
    df = spark.createDataFrame([(a, b, z, float(x), float(y), d) for a, b, z, x, y, d in known], "lon double, lat double, zone int, x double, y double, off double")
    got = df.select("*", P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("lat") < 0).alias("p")).collect()
    assert all(abs(r["p"]["x"] - r["x"]) <= r["off"] and abs(r["p"]["y"] - r["y"]) <= r["off"] for r in got)
    grid = spark.range(60 * 35).select((F.col("id") % 60 + 1).cast("int").alias("zone"), (F.floor(F.col("id") / 60) * 4.7 - 79.9).alias("lat"), F.lit(0).alias("_"))
    grid = grid.select("zone", "lat", (F.col("zone") * 6 - 183 + F.pmod(F.xxhash64("zone", "lat"), F.lit(5900)) / 1000 - 2.95).alias("lon"))
    there = grid.withColumn("p", P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("lat") < 0))
    back = there.withColumn("q", P.from_utm(F.col("p.x"), F.col("p.y"), F.col("zone"), F.col("lat") < 0))
    assert back.where((F.abs(F.col("q.lon") - F.col("lon")) > 1e-9) | (F.abs(F.col("q.lat") - F.col("lat")) > 1e-9)).count() == 0
    assert grid.where(P.zone_of(F.col("lon")) != F.col("zone")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(1.0, 2.0, 4326), (1.0, 2.0, 3857)], "x double, y double, e int").select(P.to_degrees(F.col("x"), F.col("y"), F.col("e"))).collect()][1] is None


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 32))
    v = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 32))
    rows = spark.createDataFrame([(i, x.tolist(), ["a", "b", "c"][i % 3], i % 50) for i, x in enumerate(v)] + [(9000, None, "a", 1), (9001, [0.0] * 32, "a", 1)], "tile_id int, embedding array<double>, sensor string, day int")
    built = index.build(rows, "embedding", "tile_id", str(tmp_path_factory.mktemp("index")), ["sensor", "day"])
    return rows, v / np.linalg.norm(v, axis=1, keepdims=True), built


@pytest.mark.parametrize("keep,passes", [(None, lambda i: True), ("sensor = 'b'", lambda i: i % 3 == 1), ("day = 7", lambda i: i % 50 == 7)])
def test_index_finds_nine_in_ten(spark, near, keep, passes):
    rows, v, built = near
    asked = rows.where("tile_id % 100 = 0").select(F.col("tile_id").alias("query_id"), "embedding")
    got = {}
    for r in index.search_many(built, asked, "query_id", "embedding", 20, F.expr(keep) if keep else None).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["tile_id"], r["similarity"]))
    found = every = 0
    allowed = np.array([passes(i) for i in range(len(v))])
    for q in range(0, 1500, 100):
        score = np.where(allowed, v @ v[q], -2)
        best = set(np.argsort(-score)[: min(20, allowed.sum())].tolist())
        assert all(passes(i) and abs(s - score[i]) < 1e-5 for _, i, s in got[q])
        found, every = found + len(best & {i for _, i, _ in got[q]}), every + len(best)
    assert found >= 0.9 * every
    # one query at a time, with as many lists as its filter needs
    one = index.search(built, v[300].tolist(), 20, F.expr(keep) if keep else None).collect()
    assert len(one) == 20 and all(passes(r["tile_id"]) for r in one)


def test_index_holds_every_row_and_more(spark, near, tmp_path):
    rows, v, built = near
    assert built.codes.count() == 1500
    own = index.build(rows.limit(40), "embedding", "tile_id", str(tmp_path / "i"), lists=3)
    index.extend(own, spark.createDataFrame([(7777, v[5].tolist())], "tile_id int, embedding array<double>"), "embedding")
    assert own.codes.where("tile_id = 7777").count() == 1
    none = rows.where("false").select(F.col("tile_id").alias("query_id"), "embedding")
    assert index.search_many(own, none, "query_id", "embedding", 5).collect() == []
    assert index.search(index.build(rows.where("false"), "embedding", "tile_id", str(tmp_path / "e")), [1.0], 3).collect() == []


def test_image_search(spark, tmp_path):
    rng = np.random.default_rng(10)
    images = {n: rng.integers(0, 256, (24, 24, 3)).astype(np.uint8) // (i + 1) for i, n in enumerate("pqrs")}
    for n, image in images.items():
        (tmp_path / f"{n}.png").write_bytes(png(image))
    (tmp_path / "x.png").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1][0]: r for r in R.image_embeddings(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert "unable" in got["x"]["error"] and got["x"]["embedding"] is None
    tiles = spark.createDataFrame([(i, got[n]["embedding"]) for i, n in enumerate("pqrs")], "tile_id int, embedding array<float>")
    request = search.image_request(png(images["r"]), top_k=2)
    best = vector.top_k(tiles, "embedding", vector.literal(request.vector), 1, "tile_id").collect()[0]
    assert best["tile_id"] == 2 and best["similarity"] > 0.9999 and request.placeholder and request.image
