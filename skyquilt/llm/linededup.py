"""Removal of repeated runs of lines by a suffix array over line numbers.

Every line is a symbol. Distributed prefix doubling sorts the suffixes: round k ranks the
blocks of 2^k lines by the ranks of their halves, and a suffix whose block is unique leaves
the rounds, so only repeated material is ever sorted again. Suffixes of equal rank in
round k are an interval of the suffix array whose common prefix has at least 2^k lines. The
rounds are then taken backwards: each line's longest repeated block is lengthened by halves
for as long as an earlier line starts alike, which gives for every line the longest run from
it that has an earlier copy anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, parts_of

#: Words of a run at least for its later copies to be deleted.
LEAST_WORDS = 50
#: A line with a word.
WORDED = r"[^\x20\x09-\x0D]"


def ranked(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Add `rank`, numbers that rise in `order`: a range sort, then each row's number in it."""
    dealt = blocks.repartitionByRange(parts_of(blocks.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("rank", F.monotonically_increasing_id()), forget=True)


def _place() -> Column:
    return F.struct("doc", "body", "i")


def _class(*of: Column | str) -> Column:
    """The number, of 128 bits, of the runs that are alike in `of`."""
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def _lengthened(runs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Runs that go on for 2^k more lines, if an earlier line has them too; `blocks` are those of round k.

    Runs of a class have the same `size` lines and `first` is the earliest place of these.
    Of the places that share a longer run the earliest keeps its class, or is its first, so
    a class always has the earliest place of everything that its runs may go on with.
    """
    heads = runs.groupBy("class").agg(F.min("size").alias("size"), F.min("first").alias("first"))
    heads = heads.select("first.doc", "first.body", "first.i", "size", "class", "first", F.lit(False).alias("own"))
    behind = blocks.select(F.col("doc").alias("doc_2"), F.col("body").alias("body_2"), F.col("i").alias("i_2"), "rank")
    same = F.col("doc").eqNullSafe(F.col("doc_2")) & (F.col("body") == F.col("body_2")) & (F.col("i") + F.col("size") == F.col("i_2"))
    kept = ["doc", "body", "i", "size", "class", "first"]
    both = cut(runs.withColumn("own", F.lit(True)).unionByName(heads).join(behind, same, "left").select(*kept, "own", "rank"), forget=True)
    groups = both.where("rank is not null").groupBy("class", "rank").agg(F.count("*").alias("c"), F.min(_place()).alias("head")).where("c > 1").drop("c")
    going = both.where("own and rank is not null").join(groups, ["class", "rank"], "left")
    on = F.col("head").isNotNull() & (_place() != F.col("head"))
    longer = {"size": F.col("size") + (1 << k), "class": _class("class", F.lit(k), "rank"), "first": F.col("head")}
    going = going.select(*[F.when(on, longer[c]).otherwise(F.col(c)).alias(c) if c in longer else F.col(c) for c in kept])
    return cut(going.unionByName(both.where("own and rank is null").select(*kept)), forget=True)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, body, start, stop: the maximal runs of lines [start, stop) that have an earlier copy in the corpus.

    Lines with words are counted from 0 in each document; doc and body (a hash of the text)
    name a document, and the corpus is in the order of (doc, body), null ids first. Any run
    that starts at an earlier place too lies in one of these; copies may overlap.
    """
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("body"), F.posexplode(F.filter(F.split(text_col, "\n", -1), lambda x: x.rlike(WORDED))).alias("i", "line"))
    # 128 bits tell lines apart
    lines = cut(lines.select("doc", "body", "i", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")).distinct())
    first = ranked(lines.groupBy("h", "h2").agg(F.count("*").alias("c"), F.min(_place()).alias("first")).where("c > 1"), ["h", "h2"])
    now = cut(lines.join(first.select("h", "h2", "rank", "first"), ["h", "h2"]).select("doc", "body", "i", "rank", "first"), forget=True)
    rounds, blocks = [], None
    while True:
        k = len(rounds)
        size = 1 << k
        rounds.append(now)
        later = now.select("doc", "body", "i", F.lit(k).alias("k"), "rank", "first").where(_place() != F.col("first"))
        blocks = later if blocks is None else blocks.unionByName(later)
        # a block twice as long: two of this round's, one behind the other
        behind = now.select(F.col("doc").alias("doc_2"), F.col("body").alias("body_2"), (F.col("i") - size).alias("i_2"), F.col("rank").alias("rank_2"))
        same = F.col("doc").eqNullSafe(F.col("doc_2")) & (F.col("body") == F.col("body_2")) & (F.col("i") == F.col("i_2"))
        both = cut(now.join(behind, same).select("doc", "body", "i", F.col("rank").alias("rank_1"), "rank_2"), forget=True)
        groups = ranked(both.groupBy("rank_1", "rank_2").agg(F.count("*").alias("c"), F.min(_place()).alias("first")).where("c > 1"), ["rank_1", "rank_2"])
        if groups.isEmpty():
            break
        now = cut(both.join(groups.select("rank_1", "rank_2", "rank", "first"), ["rank_1", "rank_2"]).select("doc", "body", "i", "rank", "first"), forget=True)
    # each line's longest block with an earlier copy
    longest = blocks.groupBy("doc", "body", "i").agg(F.max("k").alias("k"), F.max_by("rank", "k").alias("rank"), F.max_by("first", "k").alias("first"))
    longest = cut(longest.select("doc", "body", "i", "k", F.expr("shiftleft(1, k)").alias("size"), _class("k", "rank").alias("class"), "first"), forget=True)
    runs = longest.where("k < 0").drop("k")
    for k in range(len(rounds) - 1, 0, -1):
        runs = _lengthened(runs.unionByName(longest.where(F.col("k") == k).drop("k")), rounds[k - 1], k - 1)
    runs = runs.unionByName(longest.where("k = 0").drop("k")).select("doc", "body", F.col("i").alias("start"), (F.col("i") + F.col("size")).alias("stop"))
    # a run from the next line goes at least as far; one that ends alike lies in the one before
    before = F.lag("stop").over(Window.partitionBy("doc", "body").orderBy("start"))
    return runs.withColumn("before", before).where("before is null or stop > before").drop("before")


def without(text: str, runs: list[dict], least_words: int) -> tuple[str, int, int, int]:
    """The text without the lines of its long runs; its lines, the removed ones, and their words."""
    lines = text.split("\n")
    counts = [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]
    worded = [n for n, c in enumerate(counts) if c]
    gone: set[int] = set()
    for run in runs:
        own = worded[run["start"] : run["stop"]]
        if sum(counts[n] for n in own) >= least_words:
            gone.update(own)
    if not gone:
        return text, len(lines), 0, 0
    kept = [x for n, x in enumerate(lines) if n not in gone]
    if len(gone) == len(worded):
        kept = []
    return "\n".join(kept), len(lines), len(gone), sum(counts[n] for n in gone)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with the text less its repeated runs, then n_lines, n_removed, removed_words.

    Of any run of lines with `least_words` words or more, the first copy in the order of the
    id stays and later ones go, whatever they stand in and wherever parts of them were seen
    before, in whole documents too (whose text is then empty). Lines are
    equal if their characters are (told by 128-bit hashes); lines without words neither match nor part a run. A null
    text stays null and has no lines; a null id comes first; rows with the same id and text
    count as one document, so they get equal results. A column of `docs` named like an added one is
    replaced. An empty table gives an empty result.
    """
    runs = repeated_runs(docs, id_col, text_col)
    per = cut(runs.groupBy("doc", "body").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs")))
    added = ["n_lines", "n_removed", "removed_words"]
    keep = [c for c in docs.columns if c not in (text_col, *added)]
    put = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(put.alias("_row"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_body"))
    # texts are shuffled once, at any size
    joined = rows.join(per.hint("merge"), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_body") == F.col("body")), "left")
    joined = joined.select("_row", "_text", F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")).alias("_runs"))
    kind = joined.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [(None, 0, 0, 0) if t is None else without(t, r, least_words) for t, r in zip(part.column("_text").to_pylist(), part.column("_runs").to_pylist())]
                if out:
                    yield pa.RecordBatch.from_arrays([part.column("_row"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=["_row", "_text", *added])

    out = joined.mapInArrow(run, f"_row {kind}, _text string, n_lines long, n_removed long, removed_words long")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated runs, less those of which nothing is left; n_chars, if there, set anew."""
    out = dedup_lines(docs, least_words, id_col, text_col).where((F.col("n_removed") == 0) | (n_words(text_col) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
