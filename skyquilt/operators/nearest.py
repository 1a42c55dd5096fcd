"""Nearest landmarks by blocks of neighbours: exact, and without a cell that holds most of the landmarks.

Places are unit vectors, whose product falls as their distance grows, round the globe and for latitudes over the
pole alike. Landmarks lie in blocks, each with a box turned its way. Points go in groups to the block that can be
nearest, and then, knowing how near its landmarks are, to the other blocks whose boxes may hold a nearer one.
Only the boxes, one for some hundred landmarks, are known to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.lineage import cut

#: Landmarks of a block and points of a group, at most.
BLOCK = 1_024
#: Products that differ by less may be of equal distances, as rounding has them; distances decide then.
SLACK = 1e-14
#: Copies of a block that points of many groups are dealt over; rows that one task cuts into groups, about; point and box pairs that are held at once.
COPIES, ROWS_OF_A_TASK, HELD = 8, 250_000, 1_000_000


#: Rows of arrays that a task sends at once: a batch of them is held by Python and, once more, by Spark.
SENT = 32


def sent(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows as tables of SENT rows at most."""
    while part := list(islice(rows, SENT)):
        yield pd.DataFrame(part, columns=columns)


@dataclass
class Boxes:
    """Of each block: its number, the axes of its box (3 x 3), the box's bounds along them, a landmark near its middle, and how far from that one the others lie."""

    block: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mark: np.ndarray
    reach: np.ndarray

    def __getitem__(self, at: np.ndarray) -> Boxes:
        return Boxes(self.block[at], self.axes[at], self.low[at], self.high[at], self.mark[at], self.reach[at])

    def most(self, q: np.ndarray) -> np.ndarray:
        """For each vector and box, no product with a landmark of the box is above this."""
        turned = (q @ self.axes.transpose(1, 0, 2).reshape(3, -1)).reshape(len(q), -1, 3)
        return np.maximum(turned * self.low, turned * self.high).sum(2)

    def near(self, q: np.ndarray) -> Boxes:
        """The boxes that may hold a nearest landmark of any of the vectors: no landmark `a` is nearer to all of them than the whole box is."""
        middle = q.mean(0)
        half = np.linalg.norm(q - middle, axis=1).max()
        a = self.mark[(self.mark @ middle).argmax()]
        gain = self.most(middle[None])[0] - middle @ a + half * (np.linalg.norm(self.mark - a, axis=1) + self.reach)
        return self[gain >= -SLACK]


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)


def axes_of(v: np.ndarray) -> np.ndarray:
    """East, north and up (columns) at the middle of some vectors."""
    up = v.mean(0)
    n = np.linalg.norm(up)
    up = up / n if n > 1e-9 else np.array([1.0, 0.0, 0.0])
    east = np.cross([0.0, 0.0, 1.0] if abs(up[2]) < 0.999 else [1.0, 0.0, 0.0], up)
    east /= np.linalg.norm(east)
    return np.stack([east, np.cross(up, east), up], 1)


def groups(v: np.ndarray) -> list[np.ndarray]:
    """Rows of vectors in groups of BLOCK at most, halved along their longer side."""
    plane = v @ axes_of(v)[:, :2]
    left, out = [np.arange(len(v))], []
    while left:
        rows = left.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(plane[rows, np.ptp(plane[rows], axis=0).argmax()], half)]
        left += [rows[:half], rows[half:]]
    return out


def in_order(places: DataFrame) -> DataFrame:
    """Distinct places (lon, lat) dealt by ranges along a curve through the cube around the globe, in its order."""

    def spread(c: Column) -> Column:
        # every third bit, of 20
        c = F.least(F.floor((c + 1) * (1 << 19)), F.lit((1 << 20) - 1)).cast("long")
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
        return c

    x, y = F.radians("lon"), F.radians("lat")
    code = spread(F.cos(y) * F.cos(x)).bitwiseOR(F.shiftleft(spread(F.cos(y) * F.sin(x)), 1)).bitwiseOR(F.shiftleft(spread(F.sin(y)), 2))
    parts = max(places.sparkSession.sparkContext.defaultParallelism, -(-places.count() // ROWS_OF_A_TASK))
    rows = places.select("lon", "lat").distinct().withColumn("_at", code)
    return rows.repartitionByRange(parts, "_at").sortWithinPartitions("_at").select("lon", "lat")


def blocks_of(marks: DataFrame) -> DataFrame:
    """block, lon, lat (arrays), box: the distinct places of landmarks in blocks."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        number = (TaskContext.get().partitionId()) << 32
        for batch in batches:
            lon, lat = batch["lon"].to_numpy(), batch["lat"].to_numpy()
            v = unit_vectors(lon, lat)
            for rows in groups(v) if len(v) else []:
                axes = axes_of(v[rows])
                turned = v[rows] @ axes
                mark = v[rows][turned[:, 2].argmax()]
                reach = np.linalg.norm(v[rows] - mark, axis=1).max()
                yield number, lon[rows], lat[rows], np.concatenate([axes.ravel(), turned.min(0), turned.max(0), mark, [reach]])
                number += 1

    return in_order(marks).mapInPandas(lambda batches: sent(made(batches), ["block", "lon", "lat", "box"]), "block long, lon array<double>, lat array<double>, box array<double>")


def boxes_of(blocks: DataFrame) -> Boxes:
    rows = blocks.select("block", "box").collect()
    b = np.array([r["box"] for r in rows], float).reshape(-1, 19)
    return Boxes(np.array([r["block"] for r in rows], np.int64), b[:, :9].reshape(-1, 3, 3), b[:, 9:12], b[:, 12:15], b[:, 15:18], b[:, 18])


COLUMNS = ["block", "lon", "lat", "best"]
ASKS = "block long, lon array<double>, lat array<double>, best array<double>"


def first_asked(points: DataFrame, boxes: Boxes) -> DataFrame:
    """Groups of points, each with the block whose box comes nearest to them; nothing is known of their distances yet (best: -2)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            lon, lat = batch["lon"].to_numpy(), batch["lat"].to_numpy()
            v = unit_vectors(lon, lat)
            for rows in groups(v) if len(v) and len(boxes.block) else []:
                near = boxes.near(v[rows])
                step = max(1, HELD // len(near.block))
                pick = np.concatenate([near.most(v[rows[i : i + step]]).argmax(1) for i in range(0, len(rows), step)])
                for n in np.unique(pick):
                    at = rows[pick == n]
                    yield near.block[n], lon[at], lat[at], np.full(len(at), -2.0)

    return in_order(points).mapInPandas(lambda batches: sent(made(batches), COLUMNS), ASKS)


def further_asked(answers: DataFrame, boxes: Boxes) -> DataFrame:
    """The points of answers, with each other block that may hold a landmark as near as their best one."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for asked, lon, lat, best in zip(batch["block"], batch["lon"], batch["lat"], batch["best"]):
                v = unit_vectors(lon, lat)
                near = boxes.near(v)
                near = near[near.block != asked]
                step = max(1, HELD // max(1, len(near.block)))
                for i in range(0, len(v) if len(near.block) else 0, step):
                    able = near.most(v[i : i + step]) >= best[i : i + step, None] - SLACK
                    for n in np.flatnonzero(able.any(0)):
                        at = i + np.flatnonzero(able[:, n])
                        yield near.block[n], lon[at], lat[at], best[at]

    return answers.select("block", "lon", "lat", "best").mapInPandas(lambda batches: sent(made(batches), COLUMNS), ASKS)


def answered(asks: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """block, lon, lat, best of the asks, with the products of their nearest landmarks so far, and met: their landmarks (lon2, lat2) that are as near, but for rounding.

    Blocks and asks are dealt by block, a block over some copies, and sorted so that a task has one block at a time, before its asks.
    """
    both = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), "lon", "lat", F.lit(None).cast("array<double>").alias("best"), F.lit(0).alias("kind"))
    both = both.unionByName(asks.select("block", F.pmod(F.hash("lon", "lat"), F.lit(COPIES)).alias("copy"), "lon", "lat", "best", F.lit(1).alias("kind")))
    both = both.repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        marks = None
        for batch in batches:
            for block, kind, lon, lat, best in zip(batch["block"], batch["kind"], batch["lon"], batch["lat"], batch["best"]):
                if kind == 0:
                    marks = lon, lat, unit_vectors(lon, lat)
                    continue
                product = unit_vectors(lon, lat) @ marks[2].T
                best = np.maximum(best, product.max(1))
                who, which = np.nonzero(product >= best[:, None] - SLACK)
                yield block, lon, lat, best, lon[who], lat[who], marks[0][which], marks[1][which]

    return both.mapInPandas(lambda batches: sent(made(batches), [*COLUMNS, "met_lon", "met_lat", "lon2", "lat2"]), ASKS + ", met_lon array<double>, met_lat array<double>, lon2 array<double>, lat2 array<double>")


def nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """lon, lat, lon2, lat2: for each distinct point the place of its nearest landmark, and of any other one as near but for rounding.

    points and marks: lon, lat. Places that are missing or not finite have no row.
    """
    whole = lambda rows: rows.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where((F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf")))
    blocks = cut(blocks_of(whole(marks)))
    boxes = boxes_of(blocks)
    asks = cut(first_asked(whole(points), boxes))
    tasks = 2 * points.sparkSession.sparkContext.defaultParallelism
    parts = max(tasks, -(-asks.count() // BLOCK))
    first = cut(answered(asks, blocks, parts))
    asks = cut(further_asked(first, boxes))
    more = answered(asks, blocks, max(tasks, -(-asks.count() // BLOCK)))
    pairs = F.inline(F.arrays_zip(F.col("met_lon").alias("lon"), F.col("met_lat").alias("lat"), "lon2", "lat2"))
    return first.select(pairs).unionByName(more.select(pairs))
