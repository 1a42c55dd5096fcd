"""Rasters read window by window: one input partition a window, so that a task holds one window at a time.

Rasters are NumPy packs (.npy of (bands, height, width)); GeoTIFF is read the same way where
rasterio is installed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, row_off int, col_off int, h int, w int, band int, pixels array<double>"


@dataclass
class Window(InputPartition):
    path: str
    row: int
    col: int
    h: int
    w: int


def _open(path: str):
    """The array of a raster, mapped rather than loaded, or a rasterio data set."""
    import numpy as np

    if path.endswith(".npy"):
        return np.load(path, mmap_mode="r")
    try:
        import rasterio
    except ImportError as e:
        raise RuntimeError("GeoTIFF needs rasterio") from e
    return rasterio.open(path)


def _shape(raster) -> tuple[int, int]:
    return (raster.height, raster.width) if hasattr(raster, "height") else raster.shape[1:]


def _bands(raster, p: Window):
    if hasattr(raster, "height"):
        from rasterio.windows import Window as Part

        return raster.read(window=Part(p.col, p.row, p.w, p.h))
    return raster[:, p.row : p.row + p.h, p.col : p.col + p.w]


class WindowReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int) -> None:
        self.paths, self.size = paths, size

    def partitions(self) -> list[Window]:
        out = []
        for path in self.paths:
            height, width = _shape(_open(path))
            for r in range(0, height, self.size):
                for c in range(0, width, self.size):
                    h, w = min(self.size, height - r), min(self.size, width - c)
                    if h >= self.size // 2 and w >= self.size // 2:
                        out.append(Window(path, r, c, h, w))
        return out

    def read(self, partition: Window):
        for band, values in enumerate(_bands(_open(partition.path), partition)):
            yield partition.path, partition.row, partition.col, partition.h, partition.w, band, values.ravel().astype(float).tolist()


class SceneWindows(DataSource):
    """spark.read.format("scene_windows").option("paths", "a.npy;b.npy").option("size", 256)"""

    @classmethod
    def name(cls) -> str:
        return "scene_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WindowReader(self.options["paths"].split(";"), int(self.options.get("size", "256")))
