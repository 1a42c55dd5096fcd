"""Divergence audit, removal of repeated word sequences, and vector codes, each against a brute-force version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skyquilt.llm import divergence as D
from skyquilt.llm import fmindex as I
from skyquilt.llm import substring as S
from skyquilt.llm import vectorcodes as V

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


# divergence


def brute_audit(rows, k=200, least=3):
    """(lang, source, part, item, value, rank) by definition; rows: text, lang, source."""
    counts, langs, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(FOLD) for t in TERMS.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    kept = {lang: [t for t in langs[lang] if docs[lang][t] >= least] for lang in {g[0] for g in groups}}

    def shares(count, terms):
        n = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 1) // (n + len(terms)) for t in terms}

    of_group = {g: shares(counts[g], kept[g[0]]) for g in groups}
    of_lang = {lang: shares(langs[lang], kept[lang]) for lang in kept}
    f = lambda p, q: (p - q) ** 2 // q
    for g in groups:
        p = of_group[g]
        pairs = [(o[1], sum(f(p[t], of_group[o][t]) for t in kept[g[0]])) for o in groups if o[0] == g[0] and o != g]
        terms = [(t, f(p[t], of_lang[g[0]][t])) for t in kept[g[0]] if counts[g][t] and p[t] > of_lang[g[0]][t]]
        for part, items, most in (("pair", pairs, 10**9), ("term", terms, k)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def some_docs(seed, n=150):
    rng = random.Random(seed)
    stock = ["the", "The", "of", "naïve", "ÉTÉ", "été", "日本", "x1y", "a-b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "b", "c", None, ""])
        bias = {"hot": 40, "b": 90}.get(source, 200)
        out.append((" ".join(rng.choice(stock[: bias + 9]) for _ in range(rng.randint(0, 60))), lang, source))
    return out + [(None, "en", "empty"), ("", "fr", "x"), ("once only", "fr", "y"), out[0], out[0]]


@pytest.mark.parametrize("seed,k", [(1, 200), (2, 5), (3, 1)])
def test_audit_equals_brute_force(spark, seed, k):
    rows = some_docs(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, term string")
    assert sorted(tuple(r) for r in D.audit(df, k).collect()) == brute_audit(rows, k)


def test_audit_of_nothing(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    got = D.audit(spark.createDataFrame([("a b", "en", "x"), (None, "en", None)], "text string, lang string, source string")).collect()
    assert sorted(tuple(r) for r in got) == [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]


def test_closed_buckets_hold_nothing_better(spark):
    # one wave must do where a few terms stand out, and the rest are still right where none does
    rows = [("common " * 50 + f"t{chr(97 + i % 26)} u{chr(97 + i % 20)}", "en", "a" if i % 2 else "b") for i in range(120)] + [("rare rare rare", "en", "a")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.audit(df, 2).collect()) == brute_audit(rows, 2)


def test_large_counts_do_not_overflow(spark):
    rows = [(10**14, 5 * 10**14), (0, 7), (6, 7), (123456789012, 999999999999)]
    df = spark.createDataFrame(rows, "n long, total long")
    assert [r[0] for r in df.select(D.share("n", "total")).collect()] == [1 + 10**9 * (n + 1) // t for n, t in rows]
    assert spark.createDataFrame([(0, 0)], "n long, total long").select(D.share("n", "total")).collect()[0][0] is None


# index


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_repeated_window(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters, least = rng.choice([2, 3, 6, 50]), rng.choice([2, 3, 5, 8])
        base, texts = [rng.randrange(letters) for _ in range(60)], []
        for _ in range(rng.randint(1, 12)):
            a = rng.randrange(50)
            s = base[a : a + rng.randint(1, 40)] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
            texts.append([x if rng.random() > 0.05 else rng.randrange(letters) for x in s])
        weights = [rng.choice([1, 1, 1, 2]) for _ in texts]
        index = I.FmIndex(np.array([x for s in texts for x in s], np.uint64), np.array([len(s) for s in texts]), np.array(weights))
        count = Counter()
        for s, w in zip(texts, weights):
            for i in range(len(s) - least + 1):
                count[tuple(s[i : i + least])] += w
        got = {(int(q), i) for q, a, b in zip(*index.repeats(least)) for i in range(a, b - least + 1)}
        assert got == {(n, i) for n, s in enumerate(texts) for i in range(len(s) - least + 1) if count[tuple(s[i : i + least])] >= 2}


def test_suffix_array_and_backward_search():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 200)
    assert I.suffix_array(text).tolist() == sorted(range(200), key=lambda i: text[i:].tolist())
    flat = rng.integers(0, 4, 300).astype(np.uint64)
    index = I.FmIndex(flat, np.array([300]), np.array([1]))
    for m in (1, 2, 4, 7):
        for _ in range(20):
            want = flat[rng.integers(0, 290) :][:m] if rng.random() < 0.7 else rng.integers(0, 4, m).astype(np.uint64)
            low, high = np.array([0]), np.array([len(index.text)])
            for c in want[::-1]:
                low, high = index.back(low, high, np.searchsorted(np.unique(flat), [c]) + 1)
            assert max(0, int(high[0] - low[0])) == sum((flat[i : i + m] == want).all() for i in range(300 - m + 1))


# repeated word sequences


def brute_repeats(rows):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def repeating_docs(seed, n=60):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(400)] + ["naïve", "漢字", "x y", "\U0001f600"]
    passages = [[rng.choice(stock) for _ in range(rng.choice([34, 35, 36, 60, 120]))] for _ in range(5)]
    space = lambda w: "".join(x + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for x in w)
    rows = []
    for i in range(n):
        w = [rng.choice(stock) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            w[at:at] = p
        if rows and rng.random() < 0.1:
            w = WORDS.findall(rng.choice(rows)[1])
        rows.append((i, space(w)))
    period = [f"p{i}" for i in range(7)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, " ".join(period * 30)), (1004, "same " * 3000), (1005, " ".join(f"u{i}" for i in range(5000))), (1006, "a " * 34), (1007, "a " * 35), (1008, "b " * 36)]
    rows += [(1009, rows[0][1]), (1009, rows[0][1]), (None, "no id " * 30), (1010, " ".join(f"v{i}" for i in range(40)))] * 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    rows = repeating_docs(seed)
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_words int, key string")
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    want = sorted(brute_repeats(rows), key=key)
    got = S.without_repeats(df, digest=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want), key=key)
    assert got[0]["key"] == "z" and got[0].__fields__ == ["doc_id", "key", "n_words", "n_removed", "kept_sha256"]
    texts = S.without_repeats(df).collect()
    nulls = {i for i, t in rows if t is None}
    assert sorted(((r["doc_id"], r["text"]) for r in texts), key=key) == sorted(((i, None if i in nulls else t) for i, _, _, t in want), key=key)


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_RUNS", 3)
    monkeypatch.setattr(S, "OWNERS", 4)
    monkeypatch.setattr(S, "SHARD_WORDS", 500)
    rows = repeating_docs(9)
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    want = Counter((i, m, hashlib.sha256(t.encode()).hexdigest()) for i, _, m, t in brute_repeats(rows))
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_no_documents(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string"), digest=True).collect() == []
    assert S.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["text"] is None


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    seen = {}
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "b", " ", "\n", "\x0b", "é", "  "]) for _ in range(rng.randint(0, 30))).encode() for _ in range(rng.randint(1, 9))]
        h, n = S.hashed_words(pa.array([b"zz", *texts], pa.binary()).slice(1))
        words = [x.split() for x in texts]
        assert n.tolist() == [len(w) for w in words]
        for word, value in zip([x for w in words for x in w], h.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    long = b"q" * 10000
    assert len(set(S.hashed_words(pa.array([long + b" " + long[1:] + b" " + long], pa.binary()))[0].tolist())) == 2


# vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codes by definition, in exact integers; rows: id, vector, label."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[n][p] for n in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            for e, m in members.items():
                books[p][e] = [sum(x) // len(m) for x in zip(*m)]
    out, by_label = [], Counter()
    for (i, _, label), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


def some_vectors(seed, n, dims=8, spread=0.01):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(n + j, rows[j % n][1], 3) for j in range(n // 3)]
    return rows


@pytest.mark.parametrize("seed,n,spread", [(1, 60, 0.002), (2, 40, 1.0), (3, 3, 0.1), (4, 50, 900.0)])
def test_codes_equal_brute_force(spark, seed, n, spread):
    rows = some_vectors(seed, n, spread=spread) + [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [float("-inf")] + [0.0] * 7, None), (None, [0.5] * 8, 1), (0, [0.25] * 8, 2)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, code int").repartition(5)
    got, _ = V.compress(df, entries=16)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_codes(rows, entries=16), key=str)


def test_screening_misses_no_nearest_entry():
    rng = np.random.default_rng(2)
    for size in (1, 3, 200, 2**14, 2**24, 2**26):
        book = rng.integers(-size, size + 1, (256, 16))
        x = np.concatenate([rng.integers(-size, size + 1, (300, 16)), book[:50], (book[:50] + book[1:51]) // 2])
        entry, far = V.nearest(x, book)
        exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
        assert far.tolist() == exact.min(1).tolist() and entry.tolist() == exact.argmin(1).tolist()
    # entries that differ by less than float32 can tell, far from 0
    book = np.full((256, 16), 2**25) + rng.integers(0, 2, (256, 16))
    x = np.full((20, 16), 2**25) + rng.integers(0, 2, (20, 16))
    entry, far = V.nearest(x, book)
    exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    assert entry.tolist() == exact.argmin(1).tolist()


def test_no_vectors(spark):
    none, books = V.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.collect() == [] and books.size == 0
    odd = [(1, [0.1] * 8, 1), (2, [0.1] * 7, 1), (3, [], 1), (4, [0.2] * 12, 1), (5, [1e30] * 8, 1)]
    got, _ = V.compress(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int"))
    assert [(r["vec_id"], r["error"]) for r in got.collect()] == [(1, 0)]
