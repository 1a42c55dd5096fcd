"""Product codes for vectors: each part of a vector becomes the number of its nearest codebook entry.

Vectors are integers, floor(1024 * x), so that distances are exact. A float32 matrix product
screens all entries; each value has a bound on its rounding error, and only entries whose
interval reaches that of the best one are computed again in int64. Codebooks are fitted by
rounds over all rows: tasks sum the parts of each entry, so a round moves a row of sums for
each entry and task. Only codebooks, whose size is a parameter, pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import attach, cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Unit roundoff of float32.
UNIT = 2.0**-24


def bound(dims: int) -> int:
    """Components up to this size keep squared distances over `dims` components within int64."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def usable(vector: Column, dims: Column | int) -> Column:
    """Whether a vector has `dims` components, all finite and within `bound`; a null vector has none."""
    limit = bound(dims) / SCALE if isinstance(dims, int) else float("inf")
    # NaN is larger than any number in Spark, and infinity is as large as the open limit
    each = F.forall(vector, lambda x: x.isNotNull() & ((F.abs(x) < F.lit(limit)) if limit == float("inf") else (F.abs(x) <= F.lit(limit))))
    return vector.isNotNull() & (F.size(vector) == dims) & each


def scaled(vectors: pa.Array, dims: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `x` the nearest row of `book`, lowest first among equals, and the squared distance; both int64.

    With s = |c|^2 - 2 x.c in float32, for d components and u the unit roundoff: rounding x
    and c to float32 and summing in any order errs by at most 1.01 (d + 3) u sum |x_i c_i|, and
    rounding |c|^2 and the difference by 3 u (|c|^2 + 2 |x||c|). Norms bound the sums.
    """
    d = x.shape[1]
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    squares = (book.astype(np.float64) ** 2).sum(1)
    largest = math.sqrt(squares.max()) * (1 + 1e-9)
    product = x.astype(np.float32) @ book.astype(np.float32).T
    screen = squares.astype(np.float32)[None, :] - np.float32(2) * product
    error = 2 * 1.01 * (d + 3) * UNIT * size * largest + 4 * UNIT * (largest**2 + 2 * size * largest)
    reach = np.nextafter((screen.min(1).astype(np.float64) + 2 * error).astype(np.float32), np.float32(np.inf))
    row, entry = np.nonzero(screen <= reach[:, None])
    exact = ((x[row] - book[entry]) ** 2).sum(1)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(exact, starts)
    best = np.flatnonzero(exact == least[row])
    # entries rise within a row: the first of the best has the lowest number
    firsts = best[np.r_[True, row[best][1:] != row[best][:-1]]]
    return entry[firsts], least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows, parts) and squared distances (rows, parts)."""
    parts, _, d = books.shape
    out = [nearest(x[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
    return np.stack([o[0] for o in out], 1), np.stack([o[1] for o in out], 1)


def _blocks(batches: Iterator[pa.RecordBatch], step: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, s0, s1, ...: the count and the sums of the parts nearest to each entry."""
    parts, entries, d = books.shape
    names = ["part", "entry", "n", *[f"s{i}" for i in range(d)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, d + 1), np.int64)
        for block in _blocks(batches):
            x = scaled(block.column(0), parts * d)
            near, _ = assigned(x, books)
            for p in range(parts):
                order = np.argsort(near[:, p], kind="stable")
                at = near[order, p]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                put = p * entries + at[starts]
                total[put, 1:] += np.add.reduceat(x[order, p * d : (p + 1) * d], starts, axis=0)
                total[put, 0] += np.diff(np.r_[starts, len(at)])
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (used // entries, used % entries, *total[used].T)], names=names)

    each = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return each.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]])


def kept_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """id, vector and label of the usable rows, and the number of components.

    That number is the length of the usable vector with the smallest id whose length is a multiple of `parts`.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("_label"))
    vector = F.col("_vector")
    dealt = rows.where(usable(vector, F.size(vector)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = dealt.orderBy(F.col("_id").asc_nulls_last(), "_vector").select(F.size(vector)).first()
    dims = first[0] if first else parts
    return rows.where(usable(vector, dims)), dims


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components), int64, from the rows of `kept_rows`: the parts of the rows with the smallest ids, then rounds of means rounded down."""
    start = rows.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    x = scaled(pa.array([r[0] for r in start], pa.list_(pa.float64())), dims)
    books = np.ascontiguousarray(x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(x) else 0):
        for r in _sums(rows.select("_vector"), books).collect():
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """_id, _label, code, error of the rows of `kept_rows`: two hex digits for each part, and the squared distance to the coded entries."""
    dims = books.shape[0] * books.shape[2]
    schema = StructType([rows.schema["_id"], rows.schema["_label"], StructField("code", StringType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            if block.num_rows:
                near, far = assigned(scaled(block.column(2), dims), books)
                codes = [row.tobytes().hex() for row in near.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(codes), pa.array(far.sum(1))], names=schema.names)

    return rows.select("_id", "_label", "_vector").mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """`vec_id`, `code`, `error`, `label_error`, `codebooks_sha256` of every usable row, and the codebooks.

    `label_error` sums the error over equal labels, nulls together. Rows whose vector is null,
    holds a null, NaN or infinity, is longer or shorter than the others, or has components that
    int64 distances cannot hold (over 2^27 for 64 of them) are left out. Null ids count as the
    largest; rows with equal ids are taken in the order of their vectors, and all stay. Fewer rows
    than entries give smaller codebooks; an empty table gives an empty result. Other columns are
    not looked at. `vectors` is read once in every round: give a stored table.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    rows, dims = kept_rows(vectors, id_col, vector_col, label_col, parts)
    books = fit(rows, dims, parts, entries, rounds)
    coded = cut(encode(rows, books))
    per = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_count")))
    out = attach(coded, per, ["_label"], ["label_error"], "_count")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books
