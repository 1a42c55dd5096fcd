import random
import re

import numpy as np
import pytest

from skyquilt.llm import neardup as N

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent=80):
    """Component ids by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def made(seed, n):
    """Texts with copies, near copies of a base, chains of edits, a shared passage and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, passage, chain, out = line(90), line(60), line(80), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(90)] = rng.choice(vocabulary)
        elif kind == 1:
            words = passage + line(rng.randint(5, 90))
        elif kind == 2:
            chain[rng.randrange(80)] = rng.choice(vocabulary)
            words = list(chain)
        elif kind == 3:
            words = list(base)
        elif kind == 4:
            words = line(rng.randint(0, 5))
        else:
            words = line(rng.randint(20, 120))
        out.append((i, (" " if i % 2 else "\n").join(words).upper() if i % 5 == 0 else " ".join(words)))
    return out


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_same_as_all_pairs(spark, seed, width):
    rows = made(seed, 180)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    want = brute(rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_cells_in_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = made(3, 120)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_hot_cells_by_prefix_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "BLOCKS", 1)
    rows = made(4, 150)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_repeated_ids_keep_their_texts(spark):
    a, a2, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59)), " ".join(f"b{i}" for i in range(60))
    left = lambda rows: sorted(map(tuple, N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _h int")).collect()))
    assert left([(3, a, 0), (5, a, 0), (5, b, 0)]) == [(3, a, 0), (5, b, 0)]
    assert left([(3, a, 0), (3, a, 0), (3, a2, 0), (4, b, 0), (4, b, 0)]) in ([(3, a, 0), (4, b, 0)], [(3, a2, 0), (4, b, 0)])
    assert left([(3, a, 1), (3, a, 2)])[0][:2] == (3, a) and len(left([(3, a, 1), (3, a, 2)])) == 1
    placed = N.near_duplicates(spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in placed) == [(3, 3, True), (5, 3, False), (5, 5, True)]


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "one two", 9), (5, "ONE two", 9), (5, "ONE two", 9), (None, "one two", 9), (7, "x " * 50000, 9), (8, "x", 9), (9, "x " * 49999, 9)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles long"), 4).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, None, 7, 8, 9)] == [1, 2, 3, 4, 4, None, 7, 8, 7]
    assert by[None]["kept"] and by[1]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    kept = N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n_shingles long"), 4)
    assert kept.columns == ["doc_id", "text", "n_shingles"] and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).collect() == [] and N.deduplicated(empty).collect() == []


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, N.SLOTS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(N.SLOTS, rng.integers(0, 20), replace=False)
        b[at] ^= 1
        keys = N.chunk_keys(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(40)]
    got = {r["rep"]: r["component"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 141))
