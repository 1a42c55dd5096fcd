import random
import re

import pytest

from skyquilt.llm import linededup as L

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def gone_lines(rows, least):
    """For each text its lines with words, and the numbers of those in a run of `least` words that starts at an earlier place too."""
    lines = {i: [x for x in (t or "").split("\n") if WORDS.search(x)] for i, t in rows}
    seen, out = set(), {}
    for i in sorted(lines):
        own, gone = lines[i], set()
        for s in range(len(own)):
            n = 0
            while s + n < len(own) and tuple(own[s : s + n + 1]) in seen:
                n += 1
            if sum(len(WORDS.findall(x)) for x in own[s : s + n]) >= least:
                gone.update(range(s, s + n))
            seen.update(tuple(own[s:e]) for e in range(s + 1, len(own) + 1))
        out[i] = own, gone
    return out


def texts_left(rows, least):
    """The texts without those lines; empty if no line with words is left."""
    found, out = gone_lines(rows, least), {}
    for i, t in rows:
        own, gone = found[i]
        n, kept = -1, []
        for x in t.split("\n"):
            n += bool(WORDS.search(x))
            if not (WORDS.search(x) and n in gone):
                kept.append(x)
        out[i] = "" if gone and len(gone) == len(own) else "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    stock = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for i in range(80):
        if rows and rng.random() < 0.3:
            a = rng.choice(rows)[1].split("\n")
            s = rng.randrange(len(a))
            text = [rng.choice(stock) for _ in range(rng.randint(0, 4))] + a[s : s + rng.randint(1, 12)] + [rng.choice(stock)]
        else:
            text = [rng.choice(stock) if rng.random() < 0.5 else f"own {i} {n} " + " ".join(rng.choice(stock).split()) for n in range(rng.randint(1, 20))]
        rows.append((i, "\n".join(x if rng.random() > 0.05 else "" for x in text)))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 15).collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts_left(rows, 15)


def test_passages_stay_once(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(12)) for i in range(5))
    rows = [(3, f"start three\n{passage}\nend three"), (1, f"begin one\n{passage}"), (2, passage), (9, "short line"), (8, "short line")]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[1][1] and got[2]["text"] == "" and got[3]["text"] == "start three\nend three"
    assert got[8]["text"] == got[9]["text"] == "short line"
    assert (got[3]["n_removed"], got[3]["removed_words"]) == (5, 60)
    left = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 8, 9]


def test_odd_rows(spark):
    long = "\n".join(f"line {i} " + "word " * 5 for i in range(3000))
    rows = [(1, None, 7), (2, "", 7), (3, "\n \n", 7), (4, long, 7), (5, long, 7), (5, long, 7), (None, "a b\nc", 7), (6, "again " * 60, 7), (7, "\n".join(["again " * 60] * 3), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed long")
    got = L.dedup_lines(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[3]["text"] == "\n \n"
    assert by[4]["text"] == long and by[5]["text"] == "" and by[None]["text"] == "a b\nc"
    assert by[6]["n_removed"] == 0 and by[7]["text"] == ""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(empty).collect() == [] and L.deduplicated(empty).collect() == []


def test_parts_with_other_first_copies(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(20)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}
    x, y, z = (" ".join(f"{x}{j}" for j in range(20)) for x in "xyz")
    rows = [(0, f"{y}\n{z}"), (1, f"{x}\n{y}"), (2, f"{x}\n{y}\n{z}"), (3, f"own before\n{x}\n{y}\n{z}\nown behind")]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in range(4)] == [0, 0, 0, 3] and got[3]["text"] == "own before\nown behind"


@pytest.mark.parametrize("seed", [3, 4])
def test_same_as_definition(spark, seed):
    rng = random.Random(seed)
    stock = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        while len(text) < rng.randint(1, 40):
            a = rng.choice(rows)[1].split("\n") if rows and rng.random() < 0.5 else [rng.choice(stock)]
            s = rng.randrange(len(a))
            text += a[s : s + rng.randint(1, 25)]
        rows.append((i, "\n".join(text)))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts_left(rows, 25)
