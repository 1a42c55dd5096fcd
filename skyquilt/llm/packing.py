"""Packing documents into token sequences along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to three
dimensions, and its place on a Hilbert curve is the sort key. Documents are laid end to
end in that order and the stream is cut into sequences, so that neighbours on the curve
share sequences. Where the rows' own order matters, as after a curriculum, it is cut into
windows, and the curve orders only the documents of a window.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_total

#: Tokens of a sequence and the id that ends a document.
LENGTH, END_ID = 4096, 2
#: Tokens of a window at most, and windows at least, where the order of the rows is kept.
WINDOW, WINDOWS = 1 << 20, 16
#: Hash dimensions, projected dimensions, bits of each on the curve, and words whose ids a worker remembers.
HASHED, DIMS, BITS, REMEMBERED = 256, 3, 10, 600_000


class Words(dict):
    """The ids (as 16-bit numbers in bytes) of a run of text without space or line feed, remembered.

    The tokenizer drops white space and never joins what it parts, so a text's ids are
    those of its runs. Words of letters are looked up in lower case and apart from one
    closing mark, which the tokenizer also splits off, so that fewer are tokenized.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, run: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = b""
        if run[-1] in ".," and run[:-1].isalpha():
            ids = self[run[:-1]] + self[run[-1]]
        elif run.isalpha() and (low := run.lower()) != run and "Σ" not in run and low.isalpha() and unicodedata.is_normalized("NFC", run):
            ids = self[low]
        else:
            ids = array("H", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        self[run] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


KNOWN: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """This worker's words for a tokenizer file; they stay from task to task."""
    if path not in KNOWN:
        KNOWN[path] = Words(path)
    return KNOWN[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n x dims, each 0 to 2^bits - 1), by the transpose method."""
    x = points.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Token ids to curve keys."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            h = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.dim = (h >> np.uint64(40)).astype(np.int64) % HASHED
        self.sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
        self.project = np.random.default_rng(7).standard_normal((HASHED, DIMS))

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        v = np.stack([np.bincount(self.dim[d], self.sign[d], HASHED) for d in docs])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        at = np.clip((v @ self.project + 3) / 6, 0, 1) * ((1 << BITS) - 1)
        return hilbert(at.astype(np.int64), BITS)


def tail_sizes(rest: int) -> list[int]:
    """Powers of two that make up what is left after the last full sequence: such sequences need no padding."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def in_windows(held: DataFrame, window: int) -> DataFrame:
    """_row, _window of the rows of `held`: windows of equal token counts, `window` at most, in the order of (_file, _block, _row)."""
    total = held.agg(F.sum("_n")).collect()[0][0] or 1
    windows = max(WINDOWS, -(-total // window))
    at = running_total(held.select("_row", "_file", "_block", "_n"), [F.col("_file"), F.col("_block"), F.col("_row")], F.col("_n"), "_at")
    return at.select("_row", F.floor(F.col("_at") * windows / total).cast("long").alias("_window"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", window: int | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, and with `with_ids` token_ids.

    Each document's ids, ended by `end_id`, lie in the stream in order of (curve key, id);
    sequence n holds ids n * length to (n + 1) * length - 1 of the stream, and the rest of
    the stream after the last full sequence is cut into sequences whose sizes are powers
    of two, so nothing is padded. With `window`, the rows as they come (of a table in files,
    in the order of files' names) are cut into WINDOWS windows or more of at most so many
    tokens, which stand one behind the other, and the curve orders each of them. `docs` must then be one
    table, read or checkpointed. A null text is empty and has the end id alone; null
    ids come first among equal keys; repeated ids or rows are separate documents; an
    empty table gives an empty result; further columns are ignored. `tokenizer` is a file
    that every worker has, with ids under 65,536.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    place = [F.input_file_name(), F.input_file_block_start()] if window else [F.lit(""), F.lit(0).cast("long")]
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), place[0].alias("_file"), place[1].alias("_block"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, curve, end = words_of(tokenizer), Curve(), array("H", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [words.ids(t) + end for t in part.column(1).to_pylist()]
                keys = curve.keys([np.frombuffer(x, np.uint16) for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(keys), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["_id", "_file", "_block", "_key", "_n", "_ids"])

    held = cut(source.mapInArrow(tokens, f"_id {kind}, _file string, _block long, _key long, _n long, _ids binary").withColumn("_row", F.monotonically_increasing_id()))
    narrow = held.select("_row", "_key", "_id", "_n")
    narrow = narrow.join(in_windows(held, window), "_row") if window else narrow.withColumn("_window", F.lit(0).cast("long"))
    order = [F.col("_window"), F.col("_key"), F.col("_id").asc_nulls_first(), F.col("_row")]
    starts = running_total(narrow, order, F.col("_n"), "_start").select("_row", "_start")
    total = held.agg(F.sum("_n")).collect()[0][0] or 0
    whole = total // length
    sizes = tail_sizes(total % length)
    bounds = np.array([whole * length, *(whole * length + np.cumsum(sizes)).tolist()], dtype=np.int64)
    full_until = whole * length
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out, flat = batch.slice(at, 256), [], []
                for own, key, n, ids, first in zip(*(part.column(c).to_pylist() for c in ("_id", "_key", "_n", "_ids", "_start"))):
                    wide, done = np.frombuffer(ids, np.uint16).astype("<u4"), 0
                    while done < n:
                        here = first + done
                        if here < full_until:
                            sequence, offset, size = here // length, here % length, length
                        else:
                            k = int(np.searchsorted(bounds, here, side="right")) - 1
                            sequence, offset, size = whole + k, here - int(bounds[k]), sizes[k]
                        take = min(n - done, size - offset)
                        out.append((own, done, take, zlib.crc32(wide[done : done + take].tobytes()), n, sequence, offset, key))
                        done += take
                    flat.append(wide)
                if out:
                    kinds = [part.schema.field("_id").type] + [pa.int64()] * 7
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    if with_ids:
                        ends = np.cumsum([0, *(row[2] for row in out)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names + ["token_ids"] * with_ids)

    placed = held.join(starts, "_row").select("_id", "_key", "_n", "_ids", "_start")
    out = placed.mapInArrow(pieces, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long" + ", token_ids array<int>" * with_ids)
    return out.withColumnRenamed("_id", id_col)
