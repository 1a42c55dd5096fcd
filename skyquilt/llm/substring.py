"""Removal of word sequences that occur more than once, found by compressed indexes.

A window of 35 words belongs to its anchor, the smallest hash of the 8-word sequences in it, so
equal windows have equal anchors wherever they stand. Neighbouring windows with the same anchor
make one run of words. Runs whose anchor occurs once cannot repeat and go no further; equal runs are
counted and kept once; the others are dealt to shards by anchor. Each shard builds an FM-index
of its runs (a wavelet matrix over the Burrows-Wheeler transform, `fmindex.py`) and its runs
are streamed through it by backward search, whose matching statistics give the intervals of at
least 35 words that occur twice. Anchors of very many runs are dealt window by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, stored
from .fmindex import FmIndex

#: Words of a window, and of the sequences that anchor it.
WINDOW, ANCHOR = 35, 8
#: Words of a shard, about.
SHARD_WORDS = 150_000
#: An anchor with more runs is dealt by window.
HOT_RUNS = 5_000
#: Owners of a run that one copy of its result serves.
OWNERS = 2_000
_TEXT = ["t1", "t2"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(x * np.uint64(3) + y)


def _reduced(x: np.ndarray, width: int, join: Callable) -> np.ndarray:
    """`join` over every `width` neighbours, by doubling; for a power of two, or a join that may see a value twice."""
    size = 1
    while 2 * size <= width:
        x = join(x[:-size], x[size:])
        size *= 2
    return join(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


_INSIDE = np.array([b not in (32, *range(9, 14)) for b in range(256)])
#: A factor for each place in a word.
_FACTORS = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def hashed_words(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text.

    A word's hash is the sum of its bytes, each times a factor for its place, mixed.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    inside = _INSIDE[data]
    goes_on = np.r_[False, inside[:-1]][: len(data)]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    first = np.flatnonzero(inside & ~goes_on)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    place = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))
    inside, data = inside[first[0] :], data[first[0] :]
    longest = int(place[inside].max()) + 1
    factors = _FACTORS if longest <= len(_FACTORS) else mixed(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    parts = (data.astype(np.uint64) + np.uint64(1)) * factors[np.minimum(place, len(factors) - 1)] * inside
    return mixed(np.add.reduceat(parts, first - first[0])), np.diff(np.searchsorted(first, offsets))


def runs_of(sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, first word, words, anchor and hash of each run of the documents whose word hashes follow one another in `h`.

    A run's windows hold one place, so it has at most 2 * WINDOW - ANCHOR words, which two blocks of 32 cover.
    """
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = _reduced(h, ANCHOR, _joined)
    least = _reduced(grams, WINDOW - ANCHOR + 1, np.minimum)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    own = np.arange(len(least)) - (np.cumsum(sizes) - sizes)[doc]
    inside = own + WINDOW <= sizes[doc]
    # an anchor is a place: where the leftmost smallest one falls out, another run begins, though its hash be the same
    left = grams[: len(least) - 1] == least[:-1]
    new = np.r_[True, left | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])] & inside
    at = np.flatnonzero(new)
    n = np.bincount(np.cumsum(new)[inside] - 1, minlength=len(at)) + WINDOW - 1
    blocks = _joined(_joined(grams[:-8], grams[8:])[:-16], _joined(grams[:-8], grams[8:])[16:])
    s = _joined(_joined(blocks[at], blocks[at + n - 32]), n.astype(np.uint64))
    return doc[at], own[at], n, least[at], s


def _runs(docs: DataFrame, anchors_only: bool = False) -> DataFrame:
    """key, s, t1, t2, at, size of the runs of texts (t1, t2, text), or their keys; s is a hash of the run's words."""
    names = ["key"] if anchors_only else ["key", "s", *_TEXT, "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                h, sizes = hashed_words(part.column(2))
                doc, at, size, key, s = runs_of(sizes, h)
                columns = [pa.array(key.view(np.int64))]
                if not anchors_only:
                    owner = pa.array(doc)
                    columns += [pa.array(s.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner), pa.array(at, pa.int32()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, "key long" if anchors_only else "key long, s long, t1 long, t2 long, at int, size int")


def _shipped(texts: DataFrame, wanted: DataFrame, by_window: bool) -> DataFrame:
    """The word hashes of the runs in `wanted` (key, s, t1, t2, at, size, weight): key, s, off, weight, words, or one row for each window of them with its hash `w`."""
    lists = wanted.groupBy(*_TEXT).agg(F.collect_list(F.struct("key", "s", "at", "size", "weight")).alias("runs"))
    names = ["key", "s", "off", "weight", "words"] + (["w"] if by_window else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for n in range(batch.num_rows):
                words, runs = hashed_words(batch.column(3).slice(n, 1))[0].tobytes(), batch.column(4)[n]
                for r in runs.as_py():
                    starts = range(r["size"] - WINDOW + 1) if by_window else (0,)
                    for off in starts:
                        a = r["at"] + off
                        piece = words[8 * a : 8 * (a + (WINDOW if by_window else r["size"]))]
                        row = (r["key"], r["s"], off, r["weight"], piece)
                        out.append((*row, int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)) if by_window else row)
                if len(out) > 4096:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

    kinds = "key long, s long, off int, weight long, words binary" + (", w long" if by_window else "")
    return texts.join(lists.hint("merge"), _TEXT).select(*_TEXT, "rows", "text", "runs").mapInArrow(run, kinds)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"off": pa.int32(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(zip(*rows), names)], names=names)


def _searched(runs: DataFrame, words: int) -> DataFrame:
    """key, s, spans of the runs (key, s, weight, words) that hold something repeated; anchors are dealt to shards of about SHARD_WORDS words."""
    shards = max(1, -(-words // SHARD_WORDS))

    def search(table: pa.Table) -> pa.Table:
        column = table.column("words").combine_chunks()
        sizes = np.array([len(x) // 8 for x in column.to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        seq, start, stop = FmIndex(flat, sizes, table.column("weight").to_numpy()).repeats(WINDOW)
        order = np.argsort(seq, kind="stable")
        seq, start, stop = seq[order], start[order], stop[order]
        which, first = np.unique(seq, return_index=True)
        spans = pa.ListArray.from_arrays(pa.array(np.r_[first, len(seq)], pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["start", "stop"]))
        at = pa.array(which)
        return pa.table([table.column("key").take(at), table.column("s").take(at), spans], names=["key", "s", "spans"])

    dealt = runs.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "s", "weight", "words")
    return dealt.groupBy("shard").applyInArrow(search, "key long, s long, spans array<struct<start:int,stop:int>>")


def repeated_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts (t1, t2, rows, text) and their repeated intervals (t1, t2, spans: start and stop in words).

    t1 and t2 are two 64-bit hashes of a text and `rows` the number of rows that have it.
    """
    hashed = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = hashed.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("text").cast("binary").alias("text"))
    texts = hashed.groupBy(*_TEXT).agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    runs = _runs(hashed)
    anchors = cut(_runs(hashed, True).groupBy("key").agg(F.count("*").alias("of_key")).where("of_key > 1"))
    found = attach(runs, anchors, ["key"], ["of_key"], "of_key").where("of_key is not null")
    owners = stored(found.groupBy("key", "s", *_TEXT, "at", "size", "of_key").agg(F.count("*").alias("rows")))
    distinct = owners.groupBy("key", "s").agg(F.sum("rows").alias("weight"), F.count("*").alias("n_owners"), F.min(F.struct(*_TEXT, "at", "size")).alias("one"), F.max("of_key").alias("of_key"))
    distinct = stored(distinct.select("key", "s", "weight", "n_owners", "one.*", "of_key"))
    owners = stored(attach(owners, distinct, ["key", "s"], ["n_owners"], "n_owners"))
    is_hot = F.col("of_key") > HOT_RUNS
    cold, hot = distinct.where(~is_hot), distinct.where(is_hot)
    words = {r["hot"]: r["n"] for r in distinct.groupBy(is_hot.alias("hot")).agg(F.sum("size").alias("n")).collect()}
    spans = _searched(_shipped(texts, cold, False), words.get(False) or 0)
    if words.get(True):
        # equal windows are counted before any of them is dealt out
        windows = stored(_shipped(texts, hot, True))
        one = stored(windows.groupBy("w").agg(F.sum("weight").alias("weight"), F.count("*").alias("c"), F.first("words").alias("words")))
        again = cut(_searched(one.select(F.col("w").alias("key"), F.lit(0).cast("long").alias("s"), "weight", "words"), one.count() * WINDOW).select(F.col("key").alias("w"), F.lit(True).alias("again")))
        per = cut(one.select("w", "c").join(again, "w"))
        back = attach(windows.select("w", "key", "s", "off"), per, ["w"], ["again"], "c").where("again")
        of_windows = back.groupBy("key", "s").agg(F.collect_list(F.struct(F.col("off").alias("start"), (F.col("off") + WINDOW).alias("stop"))).alias("spans"))
        spans = spans.unionByName(stored(of_windows.join(hot.select("key", "s", "n_owners"), ["key", "s"]).select("key", "s", "spans")))
    # a run of very many texts has its result copied for each share of them
    shares = F.ceil(F.col("n_owners") / OWNERS).cast("int")
    counted = spans.join(distinct.select("key", "s", "n_owners"), ["key", "s"])
    copies = counted.select("key", "s", "spans", F.explode(F.sequence(F.lit(0), shares - 1)).alias("copy"))
    placed = owners.select("key", "s", *_TEXT, "at", F.pmod(F.xxhash64(*_TEXT, "at"), shares).cast("int").alias("copy")).join(copies.hint("merge"), ["key", "s", "copy"])
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("at")).alias("start"), (x["stop"] + F.col("at")).alias("stop")))
    return texts, placed.groupBy(*_TEXT).agg(F.flatten(F.collect_list(moved)).alias("spans"))


def without_repeats(docs: DataFrame, text_col: str = "text", digest: bool = False) -> DataFrame:
    """All columns of `docs`, the text less its repeated words, then n_words and n_removed.

    A word goes if it lies in 35 consecutive words of a document that start anywhere else too, in
    the same document as well; all copies go. What is left is joined by single spaces. With `digest`
    the text is dropped and `kept_sha256`, the SHA-256 of what is left, follows. Every row is a
    document, so repeated rows lose all windows; a null text has no words and stays null (its digest
    is that of an empty text); shorter texts only have their spaces changed. Words are told
    apart by 64-bit hashes. Columns of `docs` named like an added one are replaced; an empty table
    gives an empty result.
    """
    texts, spans = repeated_spans(docs, text_col)
    names = [*_TEXT, "rows", "kept", "n_words", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = []
                for text, spans in zip(part.column(3), part.column(4).to_pylist()):
                    words = text.as_py().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for span in spans or ():
                        gone[span["start"]] += 1
                        gone[span["stop"]] -= 1
                    kept = (np.cumsum(gone)[:-1] == 0).tolist() if spans else None
                    left = b" ".join([w for w, k in zip(words, kept) if k] if spans else words)
                    out.append((hashlib.sha256(left).hexdigest() if digest else left, len(words), len(words) - sum(kept) if spans else 0))
                kept, n, removed = zip(*out)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(kept, pa.string() if digest else pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=names)

    joined = texts.join(spans.hint("merge"), _TEXT, "left").select(*_TEXT, "rows", "text", "spans")
    done = stored(joined.mapInArrow(run, f"t1 long, t2 long, rows long, kept {'string' if digest else 'binary'}, n_words long, n_removed long"))
    added = ["n_words", "n_removed"] + (["kept_sha256"] if digest else [])
    keep = [c for c in docs.columns if c not in added and not (digest and c == text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.col(text_col).isNull().alias("_null")).alias("_row"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    out = attach(rows, done, _TEXT, ["kept", "n_words", "n_removed"], "rows")
    left = {text_col: F.when(~F.col("_row._null"), F.col("kept").cast("string")), "n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept_sha256": F.col("kept")}
    return out.select(*[left[c].alias(c) if c in left else F.col(f"_row.`{c}`").alias(c) for c in [*keep, *added]])
