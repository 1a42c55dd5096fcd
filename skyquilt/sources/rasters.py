"""GeoTIFF scenes and uploaded images (TIFF and PNG) as tables.

Files come through Spark's binary file reader, so any store that Spark reads will do. A task
holds one file's bytes and decodes the strips or tiles of one window at a time; the windows
of a scene are planned where it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.operators.vector import embed_image

#: Sizes of TIFF field types, the codes of a type, and tags by number.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, DEPTH, COMPRESSION, STRIPS, PER_PIXEL, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, DATETIME, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 284, 306, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
GEOGRAPHIC, PROJECTED = 2048, 3072
#: Shares of the darkest and lightest pixels that a stretch cuts off, in per cent.
STRETCH = (2, 98)
PNG = b"\x89PNG\r\n\x1a\n"


def unpacked_bits(data: bytes) -> bytes:
    """Run-length bytes of the PackBits kind."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW of the TIFF kind: codes from the high bits on, 9 to 12 bits wide, 256 starts anew and 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(first), [], b""
    held, n, width = 0, 0, 9
    for byte in data:
        held, n = (held << 8) | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        piece = table[code] if code < len(table) else last + last[:1]
        out.append(piece)
        if last:
            table.append(last + piece[:1])
        last = piece
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


class Tiff:
    """A TIFF file's first image: size, bands, type, place, and its pixels window by window."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.end = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.end or len(data) < 8:
            raise ValueError("not a TIFF file")
        version = struct.unpack_from(self.end + "H", data, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.tags = self._directory(struct.unpack_from(self.end + ("Q" if self.big else "I"), data, 8 if self.big else 4)[0])
        self.width, self.height, self.bands = self.tags[WIDTH][0], self.tags[HEIGHT][0], self.tags.get(PER_PIXEL, (1,))[0]
        depth, kind = self.tags.get(DEPTH, (1,))[0], SAMPLES.get(self.tags.get(FORMAT, (1,))[0])
        if depth not in (8, 16, 32, 64) or not kind:
            raise ValueError(f"samples of {depth} bits are not read")
        self.type = np.dtype(f"{self.end}{kind}{depth // 8}")
        self.unpack = UNPACK.get(self.tags.get(COMPRESSION, (1,))[0])
        if self.unpack is None:
            raise ValueError(f"compression {self.tags[COMPRESSION][0]} is not read")
        self.tiled = TILE_WIDTH in self.tags
        self.chunk = (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if self.tiled else (min(self.tags.get(ROWS_PER_STRIP, (self.height,))[0], self.height), self.width)
        self.planes = self.bands if self.tags.get(PLANAR, (1,))[0] == 2 else 1
        self.at, self.sizes = (self.tags[TILES], self.tags[TILE_SIZES]) if self.tiled else (self.tags[STRIPS], self.tags[STRIP_SIZES])

    def _directory(self, at: int) -> dict[int, tuple]:
        count, entry, small = ("Q", "HHQ", 8) if self.big else ("H", "HHI", 4)
        n = struct.unpack_from(self.end + count, self.data, at)[0]
        at += struct.calcsize(self.end + count)
        step, out = struct.calcsize("=" + entry) + small, {}
        for i in range(n):
            tag, kind, length = struct.unpack_from(self.end + entry, self.data, at + i * step)
            if kind not in FIELD:
                continue
            code = f"{length}s" if FIELD[kind] == "s" else FIELD[kind] * length if len(FIELD[kind]) == 1 else FIELD[kind] * length
            where = at + i * step + step - small
            if struct.calcsize("=" + code) > small:
                where = struct.unpack_from(self.end + ("Q" if self.big else "I"), self.data, where)[0]
            out[tag] = struct.unpack_from(self.end + code, self.data, where)
        return out

    def text(self, tag: int) -> str | None:
        return self.tags[tag][0].split(b"\0")[0].decode("utf-8", "replace").strip() if tag in self.tags else None

    @property
    def nodata(self) -> float | None:
        try:
            return float(self.text(NODATA)) if self.text(NODATA) else None
        except ValueError:
            return None

    @property
    def epsg(self) -> int | None:
        """The code of the projected system, else of the geographic one."""
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return codes.get(PROJECTED) or codes.get(GEOGRAPHIC)

    @property
    def transform(self) -> list[float] | None:
        """x0, step x, turn x, y0, turn y, step y: x = x0 + step x * col + turn x * row."""
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[PIXEL_SCALE], self.tags[TIEPOINT]
            return [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        return None

    def _chunk(self, n: int, rows: int) -> np.ndarray:
        """One strip or tile as (rows, columns, samples)."""
        h, w = self.chunk
        samples = self.bands if self.planes == 1 else 1
        raw = self.unpack(self.data[self.at[n] : self.at[n] + self.sizes[n]])
        h = h if self.tiled else rows
        predictor = self.tags.get(PREDICTOR, (1,))[0]
        if predictor == 3:
            # bytes of a row are parted by significance, and each is a difference
            size = self.type.itemsize
            parts = np.frombuffer(raw, np.uint8)[: h * w * samples * size].reshape(h, w * samples * size)
            whole = np.add.accumulate(parts.reshape(h, -1, samples), axis=1, dtype=np.uint8).reshape(h, size, w * samples)
            return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(f">f{size}").reshape(h, w, samples)
        out = np.frombuffer(raw, self.type)[: h * w * samples].reshape(h, w, samples)
        return np.add.accumulate(out, axis=1, dtype=out.dtype.newbyteorder("=")) if predictor == 2 else out

    def read(self, row: int = 0, col: int = 0, h: int | None = None, w: int | None = None) -> np.ndarray:
        """The pixels of a window as (bands, h, w)."""
        h, w = h or self.height - row, w or self.width - col
        out = np.zeros((self.bands, h, w), self.type.newbyteorder("="))
        ch, cw = self.chunk
        across, down = -(-self.width // cw), -(-self.height // ch)
        for plane in range(self.planes):
            for i in range(row // ch, -(-(row + h) // ch)):
                for j in range(col // cw, -(-(col + w) // cw)):
                    piece = self._chunk((plane * down + i) * across + j, min(ch, self.height - i * ch))
                    top, left = max(row, i * ch), max(col, j * cw)
                    bottom, right = min(row + h, i * ch + piece.shape[0], self.height), min(col + w, (j + 1) * cw, self.width)
                    part = piece[top - i * ch : bottom - i * ch, left - j * cw : right - j * cw].transpose(2, 0, 1)
                    out[plane if self.planes > 1 else slice(None), top - row : bottom - row, left - col : right - col] = part[0] if self.planes > 1 else part
        return out


def png(data: bytes) -> np.ndarray:
    """The pixels of a PNG image as (h, w, channels); not interlaced, 8 or 16 bits, or a palette of 8."""
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if not head or head[2] not in (8, 16) or head[6]:
        raise ValueError("this kind of PNG is not read")
    w, h, depth, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    above, out = np.zeros(w * step, np.uint8), np.empty((h, w * step), np.uint8)
    for r, line in enumerate(lines):
        out[r] = above = unfiltered(int(line[0]), line[1:], above, step)
    image = out.view(">u2").reshape(h, w, channels) if depth == 16 else out.reshape(h, w, channels)
    return palette[image[..., 0]] if color == 3 else image


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG image from its differences to what is left of, above, or both."""
    if kind == 0:
        return line
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    rest, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, v in enumerate(rest):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def stretched(bands: np.ndarray) -> np.ndarray:
    """Three bands (3, h, w) as bytes (h, w, 3), between percentiles of all of them, or their range if these are one."""
    a = np.nan_to_num(bands.astype(np.float32), nan=0.0, posinf=255.0, neginf=0.0)
    low, high = np.percentile(a, STRETCH)
    if high <= low:
        low, high = a.min(), a.max()
    a = (a - low) / (high - low) * 255 if high > low else np.zeros_like(a)
    return np.clip(a, 0, 255).astype(np.uint8).transpose(1, 2, 0)


def rgb(data: bytes) -> np.ndarray:
    """An uploaded image as bytes (h, w, 3). Plain PNG and 8-bit RGB TIFF keep their values; other TIFFs are stretched. What cannot be read is a ValueError."""
    if not data:
        raise ValueError("the image file is empty")
    try:
        if data.startswith(PNG):
            image = png(data)
            image = (image >> 8).astype(np.uint8) if image.dtype.itemsize == 2 else image
            return np.repeat(image[..., :1], 3, axis=2) if image.shape[2] < 3 else image[..., :3]
        tiff = Tiff(data)
        bands = tiff.read()
        if tiff.bands in (3, 4) and tiff.type.itemsize == 1 and GEO_KEYS not in tiff.tags:
            return bands[:3].transpose(1, 2, 0)
        order = {1: [0, 0, 0], 2: [0, 1, 0]}.get(tiff.bands, [0, 1, 2])
        return stretched(bands[order])
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"unable to identify or decode the image: {e}") from e


def _each(files: DataFrame, schema: str, names: list[str], rows_of, columns: tuple[str, ...] = ("path", "content")) -> DataFrame:
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for row in rows_of(path.as_py(), content.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    out = files.sparkSession.createDataFrame([], schema).schema
    kinds = [to_arrow_type(f.dataType) for f in out]
    return files.select(*columns).mapInArrow(run, out)


def scenes(files: DataFrame) -> DataFrame:
    """A row for each file (path, content): height, width, bands, type, epsg, transform, nodata, datetime, metadata, and error where it cannot be read."""
    names = ["path", "height", "width", "bands", "type", "epsg", "transform", "nodata", "datetime", "metadata", "error"]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            t = Tiff(data)
            yield path, t.height, t.width, t.bands, t.type.name, t.epsg, t.transform, t.nodata, t.text(DATETIME), t.text(METADATA), None
        except (ValueError, KeyError, IndexError, struct.error) as e:
            yield path, *[None] * 9, str(e)

    return _each(files, "path string, height int, width int, bands int, type string, epsg int, transform array<double>, nodata double, datetime string, metadata string, error string", names, rows)


def windows(files: DataFrame, size: int = 256) -> DataFrame:
    """path, row_off, col_off, h, w, band (from 1), pixels (row by row, nodata as null) of each window of each readable scene; fragments under half a window are left out."""
    names = ["path", "row_off", "col_off", "h", "w", "band", "pixels"]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            t = Tiff(data)
        except (ValueError, KeyError, IndexError, struct.error):
            return
        for r in range(0, t.height, size):
            for c in range(0, t.width, size):
                h, w = min(size, t.height - r), min(size, t.width - c)
                if h >= size // 2 and w >= size // 2:
                    for band, values in enumerate(t.read(r, c, h, w), 1):
                        flat = values.ravel().astype(float)
                        bad = np.isnan(flat) | ((flat == t.nodata) if t.nodata is not None else False)
                        yield path, r, c, h, w, band, pa.array(flat, mask=bad).to_pylist()

    return _each(files, "path string, row_off int, col_off int, h int, w int, band int, pixels array<double>", names, rows)


def placed(scene_rows: DataFrame, size: int = 256) -> DataFrame:
    """The windows of `scenes` with bounds and centre in degrees; scenes in UTM zones (EPSG 326xx, 327xx) are projected back, others must be in degrees."""
    from skyquilt.functions.projection import to_degrees
    from skyquilt.operators.spatial import tile_grid

    rows = tile_grid(scene_rows.where("transform is not null"), size)
    t = F.col("transform")
    corners = []
    for r in (F.col("row_off"), F.col("row_off") + F.col("h")):
        for c in (F.col("col_off"), F.col("col_off") + F.col("w")):
            corners.append(to_degrees(t[0] + t[1] * c + t[2] * r, t[3] + t[4] * c + t[5] * r, F.col("epsg")))
    lon, lat = F.array(*[p["lon"] for p in corners]), F.array(*[p["lat"] for p in corners])
    rows = rows.withColumns({"minx": F.array_min(lon), "maxx": F.array_max(lon), "miny": F.array_min(lat), "maxy": F.array_max(lat)})
    return rows.withColumns({"lon": (F.col("minx") + F.col("maxx")) / 2, "lat": (F.col("miny") + F.col("maxy")) / 2})


def image_embeddings(files: DataFrame) -> DataFrame:
    """path, embedding, height, width of each image file (path, content), and error where it cannot be read."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            image = rgb(data)
            yield path, embed_image(image / 255.0).tolist(), image.shape[0], image.shape[1], None
        except ValueError as e:
            yield path, None, None, None, str(e)

    return _each(files, "path string, embedding array<float>, height int, width int, error string", ["path", "embedding", "height", "width", "error"], rows)
