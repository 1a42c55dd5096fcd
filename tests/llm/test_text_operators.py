import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyquilt.llm import fingerprint as FP
from skyquilt.llm import mixing as M
from skyquilt.llm import packing as K
from skyquilt.llm import quality as Q
from skyquilt.llm import queries
from skyquilt.llm import sharding as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "word " * 30000, "b"), (5, "Same text here.", "b"), (5, "Same text here.", "b"), (None, "no id", "b"), (7, "ünïcode — 漢字 \U0001f600 x", "c")]
DDL = "doc_id long, text string, source string"


def docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", size long, shard string")


def empty(spark):
    return spark.createDataFrame([], DDL)


# quality


def brute_repeats(words):
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_repeats_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        assert Q.repeated_words(w) == brute_repeats(w)


def test_lines():
    fails = lambda s: Q.line_fails(s, s.encode().split())
    assert fails("A plain sentence ends here.") == "" and fails('He said "so."') == ""
    assert fails("Home | News | Sport | More") == "navigation"
    assert fails("Please accept cookies to go on.") == "boilerplate"
    assert fails("A### b$$$ c%%%.") == "symbols" and fails("BUY!! NOW!! IT!! IS!!") == "shouting" and fails("no end") == "punctuation"


def test_quality_rows(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [*ODD, (10, good, "a"), (11, good + "\nmenu | a | b | c | d", "a"), (12, "\n".join(f"no end {i} " + " ".join(f"t{i}{j}" for j in range(9)) for i in range(20)), "a"), (13, "\n".join([good, good]), "a")]
    got = Q.assess(docs(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [by[i]["kept"] for i in (1, 2, 3, 4, 10, 11, 12, 13)] == [False] * 4 + [True, True, False, False]
    assert by[11]["cleaned"] == good and by[13]["n_dup_lines"] == 1 and by[4]["n_repeat_words"] == 30000 and by[7]["word_chars"] == 12
    assert Q.clean(docs(spark, rows)).columns == docs(spark).columns and Q.clean(empty(spark)).collect() == []


def test_clean_keeps_columns_of_other_meaning(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, good, "mine", -5, "t", "c", 7)], "doc_id long, text string, kept string, n_words int, _text string, cleaned string, _row int")
    assert Q.clean(df).columns == df.columns and tuple(Q.clean(df).collect()[0]) == (1, good, "mine", -5, "t", "c", 7)


# fingerprints


def phrases(text):
    seen, phrase = set(), ""
    for word in text.split():
        phrase = f"{phrase} {word}".strip()
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_phrases_are_those_of_a_plain_parse():
    rng = random.Random(2)
    for _ in range(100):
        text = " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 80)))
        other = " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 80)))
        p, changed = FP.Parsed(text), FP.edit(text, other)
        want = lambda t: FP.smallest(FP.hashed(sorted(phrases(t)) or [""]))
        assert (p.hashes == want(text)).all() and (p.edited(changed) == want(changed)).all()


def plain_likeness(a, b, kept=128):
    """The share of the smallest hashes of both phrase sets together that both have."""
    x, y = ({xxhash.xxh32_intdigest(p) for p in (phrases(t) or ([""] if t else []))} for t in (a, b))
    first = sorted(x | y)[:kept]
    return sum(h in x and h in y for h in first) / len(first) if first else 1.0


def test_many_parts(spark):
    rows = [(i * 7 % 3001, f"text {i} of {i % 9}") for i in range(3001)] + [(None, "no id"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, FP.fingerprints(df).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        rows, n = FP.in_parts(df, "doc_id", "text")
        made = rows.select("_id", "_part", "_also").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n == 2000 and len({r["_part"] for r in made}) > 1500
    by = sorted(made, key=lambda r: (r["_part"], r["_id"] is None, -(r["_id"] or 0)))
    assert [r["_id"] for r in by if r["_id"] is not None] == sorted((r["_id"] for r in made if r["_id"] is not None), reverse=True)
    firsts = {}
    for r in by:
        firsts.setdefault(r["_part"], r["_id"])
    parts = sorted(firsts)
    assert all(r["_also"] == (parts[parts.index(r["_part"]) - 1] if r["_id"] == firsts[r["_part"]] else None) for r in made)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(str, FP.fingerprints(df).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprint_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300)))) for i in range(200)]
    got = {r["doc_id"]: r for r in FP.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    for i, n in zip(order, [*order[1:], order[0]]):
        edited = FP.edit(texts[i], texts[n])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == FP.fingerprint(texts[i]) and got[i]["edited_fingerprint"] == FP.fingerprint(edited)
        assert got[i]["near_next"] == plain_likeness(texts[i], texts[n]) and got[i]["near_edited"] == plain_likeness(texts[i], edited)
    odd = FP.fingerprints(docs(spark)).collect()
    assert len(odd) == len(ODD) and {r["n_chars"] for r in odd if r["doc_id"] in (1, 2)} == {0}
    assert FP.fingerprints(empty(spark)).collect() == []
    alone = FP.fingerprints(docs(spark, ODD[4:5])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    common = [f"c{i}" for i in range(600)]
    a, b = common + [f"a{i}" for i in range(300)], common + [f"b{i}" for i in range(300)]
    rng.shuffle(a)
    assert abs(FP.likeness(FP.smallest(FP.hashed(a)), FP.smallest(FP.hashed(b))) - 0.5) < 0.15
    assert FP.likeness(FP.smallest(FP.hashed(a)), FP.smallest(FP.hashed(a))) == 1.0


# sharding


def test_shards(spark):
    rows = [(i + 100, f"text {i % 50}", "s") for i in range(3000)] + ODD
    got = S.shard(docs(spark, rows), S.uniform_tree(24), S.uniform_tree(25)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    slots = Counter()
    for r in got:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]] += 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in slots.items())
    assert len(slots) == 24 and max(slots.values()) < 1.6 * min(slots.values())
    assert S.shard(empty(spark), S.uniform_tree(3)).collect() == []


def test_movement_stays_in_the_changed_subtree(spark):
    rows = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    before = [("r0", 2.0, [("k0", 1.0, 0), ("k1", 1.0, 1)]), ("r1", 2.0, [("k2", 1.0, 2), ("k3", 1.0, 3)])]
    after = [("r0", 2.0, [("k0", 1.0, 0), ("k1", 1.0, 1)]), ("r1", 2.0, [("k2", 1.0, 2), ("k3", 3.0, 3)])]
    both = S.place(S.place(rows, "k", before, "a"), "k", after, "b").where("a != b")
    moved = {(r["a"], r["b"]) for r in both.select("a", "b").distinct().collect()}
    assert moved == {(2, 3)}


# mixing


def fair(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "b", "c", "d", None, "Z"])) for i in range(900)]
    got = M.mix(spark.createDataFrame(rows, DDL)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0) and 0 <= (r["position"] or 0) <= 1
    want = fair(sizes)
    assert all(math.isclose(target[s], want[s]) and taken[s] == round(target[s]) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(spark.createDataFrame(rows[::-1], DDL)).collect()))
    made = M.training_rows(spark.createDataFrame(rows, DDL))
    assert made.columns == ["doc_id", "text", "source"]
    words = Counter()
    for r in made.collect():
        words[r["source"]] += len(WORDS.findall(r["text"]))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_training_rows_of_repeated_ids_and_odd_columns(spark):
    rows = [(1, f"a{i} " * 10, "s", i, i, i, i, 3) for i in range(20)] + [(None, "n n", None, 1, 1, 1, 1, 3)] * 3
    df = spark.createDataFrame(rows, DDL + ", _left int, _id int, _turn int, _position int, _row int")
    got = M.training_rows(df).collect()
    assert M.training_rows(df).columns == df.columns
    times = Counter(r["text"].split()[0] for r in got)
    assert len(times) <= 21 and all(n <= (9 if w == "n" else 3) for w, n in times.items())
    assert all(r["_row"] == 3 and r["_left"] == (1 if r["source"] is None else int(r["text"].split()[0][1:])) for r in got)
    words = Counter()
    for r in got:
        words[r["source"]] += len(r["text"].split())
    assert words == Counter({s: round(t) for s, t in fair({"s": 200, None: 6}).items()})


def test_mix_odd_rows(spark):
    assert len(M.mix(docs(spark)).collect()) == len(ODD) and M.mix(empty(spark)).collect() == []
    assert M.training_rows(empty(spark)).collect() == []
    zero = M.mix(docs(spark, ODD[:3])).collect()
    assert {(r["target"], r["taken"]) for r in zero} == {(0.0, 0)}


@pytest.mark.parametrize("a,b", M.SCHEDULES)
def test_positions_invert_the_integral(spark, a, b):
    t = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", M.position(F.col("u"), F.lit(a), F.lit(b)).alias("t")).collect()
    assert all(math.isclose(a * r["t"] + (b - a) * r["t"] ** 2 / 2, r["u"], abs_tol=1e-12) for r in t)


# packing


def test_pack_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Alpha,", "beta.", "don't", "x<|endoftext|>y", "Straße", "12", "ΣΑΣ", "é"]) for _ in range(rng.randint(0, 400))), "s") for i in range(60)]
    rows += [r for r in ODD if r[0] not in (5, None)]
    path = queries.tokenizer_file()
    got = K.pack(docs(spark, rows), path, 512).collect()
    t = Tokenizer.from_file(path)
    want = {i + 0 if i < 60 else i: None for i, *_ in rows}
    by = {}
    for i, text, _ in rows:
        by.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    assert want.keys() == by.keys()
    seen, fill = Counter(), {}
    for r in got:
        ids = next(x for x in by[r["doc_id"]] if len(x) == r["doc_tokens"])
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == Counter({i: sum(map(len, x)) for i, x in by.items()})
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 512 or at & (at - 1) == 0
    assert sorted(fill) == list(range(len(fill)))


def test_pack_odd_rows(spark):
    path = queries.tokenizer_file()
    got = K.pack(docs(spark), path).collect()
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and sum(r["length"] for r in got if r["doc_id"] == 5) == 10
    assert K.pack(empty(spark), path).collect() == []


def test_hilbert_is_a_path():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = K.hilbert(side, 3)
    assert sorted(keys) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_word_memory_gives_the_tokenizers_ids():
    path = queries.tokenizer_file()
    words, t = K.Words(path), Tokenizer.from_file(path)
    for text in ["", " ", "A<|endoftext|>b c.", "don't I'LL   x\x1cy\x85z İ ΣΑΣ e\u0301 \u0301x K Å", "a\u200bb,c. ﬁne Word, WORD. word", "日本語。 テスト", "3.14, 2.5."]:
        assert np.frombuffer(words.ids(text), np.uint16).tolist() == t.encode(text, add_special_tokens=False).ids


def test_fingerprints_of_ids_of_any_kind(spark):
    rng = random.Random(8)
    ids = sorted({"".join(rng.choice("abäz09-") for _ in range(rng.randint(1, 4))) for _ in range(40)}, key=lambda s: s.encode())
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in ids] + [(None, "no id")]
    got = {r["doc_id"]: r for r in FP.fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()}
    ring = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0].encode(), reverse=True) + [rows[-1]]
    for (i, text), (_, after) in zip(ring, ring[1:] + ring[:1]):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    dates = spark.sql("SELECT DATE '2024-01-01' + CAST(id AS INT) AS doc_id, concat('t ', id) AS text FROM range(9)")
    assert len(FP.fingerprints(dates).collect()) == 9
