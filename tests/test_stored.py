"""Tables of committed batches: lost writes, repeated batches, removals, compaction, and ingestion into them."""

import random

import numpy as np
import pytest

from skyquilt.plans import ingest
from skyquilt.sources import stored
from tests.test_rasters import tiff

DDL, KEY = "id int, v string, at int", ["id"]


def put(spark, folder, batch, rows, **more):
    return stored.commit(spark.createDataFrame(rows, DDL), folder, batch, KEY, **more)


def held(spark, folder):
    return sorted(tuple(r) for r in stored.current(spark, folder, KEY, DDL, "at").collect())


def test_batches_count_once_and_whole(spark, tmp_path):
    t = str(tmp_path)
    assert held(spark, t) == [] and put(spark, t, "a", [(1, "x", 1), (2, "x", 1)])
    assert not put(spark, t, "a", [(1, "other", 9)])
    # a write that was lost before its commit is not seen, and its batch can be run again
    stored._written(spark.createDataFrame([(3, "lost", 1, False)], DDL + ", _removed boolean"), t, "b", KEY)
    assert held(spark, t) == [(1, "x", 1), (2, "x", 1)]
    assert put(spark, t, "b", [(1, "late", 0), (2, "y", 1), (4, None, None)])
    assert held(spark, t) == [(1, "x", 1), (2, "y", 1), (4, None, None)]


def test_removals_and_compaction(spark, tmp_path):
    t = str(tmp_path)
    put(spark, t, "a", [(1, "x", 5), (2, "x", 1)])
    put(spark, t, "b", [(1, "", 0), (7, "", 0)], removed=True)
    assert held(spark, t) == [(2, "x", 1)]
    put(spark, t, "c", [(1, "again", 1)])
    before = held(spark, t)
    stored.compact(spark, t, "one", KEY, DDL, "at")
    assert before == held(spark, t) == [(1, "again", 1), (2, "x", 1)] and list(stored.commits(spark, t)) == ["one"]
    # batches that are in the compacted one stay known
    assert not put(spark, t, "a", [(9, "x", 9)]) and put(spark, t, "d", [(2, "z", 1)])
    assert held(spark, t) == [(1, "again", 1), (2, "z", 1)]


@pytest.mark.parametrize("seed", range(2))
def test_many_batches_equal_a_dictionary(spark, tmp_path, seed):
    rng, want = random.Random(seed), {}
    for n in range(8):
        ids = rng.sample(range(12), 4)
        if rng.random() < 0.25:
            put(spark, str(tmp_path), f"b{n}", [(i, "", 0) for i in ids], removed=True)
            want = {i: r for i, r in want.items() if i not in ids}
        else:
            rows = [(i, f"{n}", rng.randint(0, 3)) for i in ids]
            put(spark, str(tmp_path), f"b{n}", rows)
            want |= {r[0]: r for r in rows if r[0] not in want or r[2] >= want[r[0]][2]}
        if n == 5:
            stored.compact(spark, str(tmp_path), "c", KEY, DDL, "at")
    assert held(spark, str(tmp_path)) == sorted(want.values())


def table(spark, folder, name):
    return stored.current(spark, f"{folder}/{name}", ["source_hash" if name == "scenes" else "tile_uuid"], getattr(ingest, name.upper()))


def test_ingestion_into_a_catalogue(spark, tmp_path, monkeypatch):
    bands = np.random.default_rng(11).integers(1, 3000, (4, 128, 128)).astype(np.uint16)
    bands[:, :64, :64] = 0  # a tile of nothing
    inside = ([0.001, 0.001, 0], [0, 0, 0, 88.1, 22.5, 0], 4326)
    src, folder = tmp_path / "in", str(tmp_path / "catalogue")
    src.mkdir()
    (src / "S2A_20240102_a.tif").write_bytes(tiff(bands, compression=8, geo=inside))
    paths = spark.read.format("binaryFile").load(str(src))
    counts = lambda: tuple(table(spark, folder, n).count() for n in ("scenes", "tiles", "vectors"))
    # the first run is lost before its scenes are committed
    plain = stored.commit

    def lost(rows, where, *more):
        if where.endswith("scenes"):
            raise RuntimeError("lost")
        return plain(rows, where, *more)

    monkeypatch.setattr(stored, "commit", lost)
    with pytest.raises(RuntimeError):
        ingest.run(paths, folder, "one", size=64)
    monkeypatch.setattr(stored, "commit", plain)
    assert counts() == (0, 3, 3)
    # the batch again: no tile twice; the empty one is judged again and left out again
    made = ingest.run(paths, folder, "one", size=64)
    assert [r["discard_reasons"] for r in made.collect()] == [["low_clear_fraction"]] and counts() == (1, 3, 3)
    assert {r["reason"]: r["n"] for r in ingest.discard_histogram(made, "discard_reasons").collect()} == {"low_clear_fraction": 1}
    first = {r["tile_uuid"]: r["embedding"] for r in table(spark, folder, "vectors").collect()}
    # a vector that is lost comes again from its scene, with a new scene in the same batch
    stored.commit(spark.createDataFrame([(min(first),)], "tile_uuid string"), f"{folder}/vectors", "gone", ["tile_uuid"], True)
    assert counts() == (1, 3, 2)
    (src / "S2A_20240107_b.tif").write_bytes(tiff(bands + 40, compression=8, geo=inside))
    made = ingest.run(spark.read.format("binaryFile").load(str(src)), folder, "two", size=64)
    assert made.count() == 4 and counts() == (2, 7, 7)
    again = {r["tile_uuid"]: r["embedding"] for r in table(spark, folder, "vectors").collect()}
    assert all(again[k] == v for k, v in first.items())
    assert ingest.run(spark.read.format("binaryFile").load(str(src)), folder, "three", size=64).count() == 0 and counts() == (2, 7, 7)
