import random
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from skyquilt.llm import quality, queries

from .test_linededup import texts_left as lines_left
from .test_neardup import brute as components
from .test_text_operators import WORDS, fair


def table(folder, spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(900)}"
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage, rows = [line(15) for _ in range(5)], []
    for i in range(150):
        kind, text = rng.randrange(8), [line(rng.randint(8, 25)) for _ in range(rng.randint(4, 9))]
        if kind == 0:
            text = [" | ".join(word() for _ in range(30)) for _ in range(4)]
        elif kind == 1 and rows:
            text = rng.choice(rows)[1].split("\n")
        elif kind == 2 and rows:
            text = [" ".join(word() if rng.random() < 0.02 else w for w in x.split()) for x in rng.choice(rows)[1].split("\n")]
        elif kind == 3:
            text = text[:2] + passage + text[2:]
        elif kind == 4:
            text = ["Tiny."]
        rows.append((i, "\n".join(text), "en", rng.choice(["a", "a", "b", "c", None]), 0))
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows] + [(900, None, "en", "a", 0), (901, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = table(tmp_path, spark)
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out[name] = docs.collect()
        assert name == "pack_sequences" or docs.columns == columns
    sources = {r[0]: r[3] for r in rows}

    kept = {r[0]: quality.judge(r[1])[8] for r in rows if quality.judge(r[1])[7]}
    assert {r["doc_id"]: r["text"] for r in out["quality_rules"]} == kept

    left = {i: t for i, t in lines_left(sorted(kept.items()), 50).items() if WORDS.search(t)}
    assert {r["doc_id"]: r["text"] for r in out["line_dedup"]} == left
    assert all(r["n_chars"] == len(r["text"]) for r in out["line_dedup"])

    one = {i: left[i] for i, (_, c) in components(sorted(left.items()), 5).items() if c == i}
    assert {r["doc_id"]: r["text"] for r in out["near_dedup"]} == one

    sizes, taken, mine = Counter(), Counter(), defaultdict(int)
    for i, t in one.items():
        sizes[sources[i]] += len(WORDS.findall(t))
    for r in out["mix_sources"]:
        assert one[r["doc_id"]].startswith(r["text"])
        taken[r["source"]] += len(WORDS.findall(r["text"]))
        mine[r["doc_id"]] += 1
    assert taken == Counter({s: round(x) for s, x in fair(sizes).items()}) and max(mine.values()) <= 3

    t = Tokenizer.from_file(queries.tokenizer_file())
    want = Counter(tuple(t.encode(r["text"], add_special_tokens=False).ids + [2]) for r in out["mix_sources"])
    ids = [x for r in sorted(out["pack_sequences"], key=lambda r: (r["sequence_id"], r["offset"])) for x in r["token_ids"]]
    ends = [-1, *(i for i, x in enumerate(ids) if x == 2)]
    assert Counter(tuple(ids[a + 1 : b + 1]) for a, b in zip(ends, ends[1:])) == want
    fill = Counter()
    for r in out["pack_sequences"]:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())
    # the stream follows the curriculum: the order of the rows is that of the positions
    order = {r["doc_id"]: [] for r in out["mix_sources"]}
    for at, r in enumerate(spark.read.parquet(str(tmp_path / "3")).selectExpr("*", "_metadata.file_path AS f", "_metadata.row_index AS i").orderBy("f", "i").collect()):
        order[r["doc_id"]].append(at)
    seen, places, rows_in = Counter(), [], len(out["mix_sources"])
    for r in sorted(out["pack_sequences"], key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0:
            places.append(sorted(order[r["doc_id"]])[seen[r["doc_id"]]])
            seen[r["doc_id"]] += 1
    assert len(places) == rows_in and max(abs(i - p) for i, p in enumerate(places)) < rows_in / 5
    # turns of a document stand apart
    last = {}
    for at, r in enumerate(sorted((r for r in out["pack_sequences"] if r["start"] == 0), key=lambda r: (r["sequence_id"], r["offset"]))):
        assert at - last.get(r["doc_id"], -rows_in) > rows_in / 10
        last[r["doc_id"]] = at


def test_stages_on_odd_rows(spark, tmp_path):
    good = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) + "." for j in range(6))
    long = " ".join(f"long{i}" for i in range(40_000)) + "."
    rows = [(1, None, "en", "a", None, "k"), (2, "", None, None, 0, "k"), (3, good(3), "en", "a", 9, "k"), (3, good(3), "en", "a", 9, "k"), (3, good(4), "en", None, 9, "k"), (None, good(5), "en", "b", 9, None), (None, good(5), "en", "b", 9, None), (8, long, "en", "b", 9, "k"), (9, good(3), "fr", "c", 9, "k")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for name, table in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(table, ddl)
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if stage != "pack_sequences":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
            if stage == "near_dedup" and table:
                left = sorted(((r["doc_id"] or 0), r["text"] == long, r["n_chars"]) for r in docs.collect())
                assert [x[0] for x in left if x[0]] == [3, 3, 8] and all(r["kept"] == ("k" if r["doc_id"] else None) for r in docs.collect())
        assert bool(docs.count()) == bool(table)


def test_run_is_the_stages(spark, tmp_path):
    table(tmp_path, spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
