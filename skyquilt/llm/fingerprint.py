"""Document fingerprints from Lempel-Ziv phrases.

The words of a text are parsed into the phrases of an incremental (LZ78) dictionary: each
phrase is a known phrase and one more word. The set of phrases is hashed and the smallest
distinct hashes are kept; two fingerprints are compared by the share of the smallest
hashes of their union that both hold, an estimate of the Jaccard likeness of the phrase
sets, which follows how well one text compresses the other.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of

#: Hashes kept in a fingerprint; code points of a parsed word at most (longer ones, as in scripts without spaces, are parted).
KEPT, LONGEST = 128, 24

PART = re.compile(rf"\S{{1,{LONGEST}}}")


def words_of(text: str) -> list[str]:
    words = text.split()
    return PART.findall(text) if words and max(map(len, words)) > LONGEST else words


def parse(words: list[str], seen: set[str], phrase: str, new: list[str]) -> str:
    """Parse on from an open `phrase`, adding new phrases to `seen` and `new`; returns the phrase left open."""
    add, put = seen.add, new.append
    for word in words:
        phrase = f"{phrase} {word}" if phrase else word
        if phrase not in seen:
            add(phrase)
            put(phrase)
            phrase = ""
    return phrase


def hashed(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))


def smallest(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The `kept` smallest distinct ones of the hashes."""
    if len(hashes) > 4 * kept:
        few = np.unique(np.partition(hashes, 2 * kept)[: 2 * kept])
        if len(few) >= kept:
            return few[:kept]
    return np.unique(hashes)[:kept]


class Parsed:
    """A text with its smallest phrase hashes, and the parse of the words that lie whole in its first half.

    An empty text has no phrases, a text of white space the empty one.
    """

    def __init__(self, text: str) -> None:
        self.text, words = text, words_of(text)
        # the last word before the half may go on behind it
        self.common = max(0, len(words_of(text[: len(text) - len(text) // 2])) - 1)
        self.first: list[str] = []
        seen: set[str] = set()
        self.open = parse(words[: self.common], seen, "", self.first)
        self.first_hashes = hashed(self.first)
        self.hashes = self._with(words[self.common :], seen) if text else hashed([])

    def _with(self, words: list[str], seen: set[str]) -> np.ndarray:
        new: list[str] = []
        parse(words, seen, self.open, new)
        if not new and not self.first:
            new = [""]
        return smallest(np.concatenate([self.first_hashes, hashed(new)]))

    def edited(self, text: str) -> np.ndarray:
        """The smallest hashes of a text that has the same first half."""
        if not text or text == self.text:
            return self.hashes
        return self._with(words_of(text)[self.common :], set(self.first))


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of the `kept` smallest hashes of both together that both hold; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    rank = np.cumsum(np.concatenate([[True], ~same])) - 1  # each value's place among the distinct ones
    return float(np.count_nonzero(same & (rank[1:] < kept)) / min(kept, rank[-1] + 1))


def shown(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """The fingerprint of one text, as a hexadecimal string."""
    return shown(Parsed(text).hashes)


def edit(text: str, following: str) -> str:
    """The text with its last len // 2 code points replaced by the first as many of `following`."""
    return text[: len(text) - len(text) // 2] + following[: len(text) // 2]


def in_parts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows with _part, a range of the id counted in descending order, and _also, the part that this row follows as the next one, or null.

    There are as many parts as shuffle partitions at most, so their bounds and first ids are
    that few numbers, in one constant array each; a row's part is found in it by halving. The
    first row of all follows the last part.
    """
    n = parts_of(docs.sparkSession)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    ids = F.col(id_col).cast("long" if whole else "string")
    narrow = docs.select(ids.alias("_id"))
    if n < 2:
        bounds = []
    elif whole:
        bounds = narrow.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n).alias("b")).collect()[0]["b"] or []
    else:
        # strings have no percentiles: those of the 50 n ids with the smallest hashes
        some = [r[0] for r in narrow.where("_id is not null").orderBy(F.xxhash64("_id")).limit(50 * n).collect()]
        some.sort(key=lambda s: s.encode("utf-8", "surrogatepass"))
        bounds = [some[len(some) * i // n] for i in range(1, n)] if some else []
    bounds = sorted(set(bounds), key=lambda v: v if whole else v.encode("utf-8", "surrogatepass"), reverse=True)
    listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    kind = "bigint" if whole else "string"
    # how many bounds are over the id
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    over = lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(listed(bounds, kind), (at + step).cast("int")) > F.col("_id")), at + step).otherwise(at)
    part = F.aggregate(listed(steps, "bigint"), F.lit(0).cast("long"), over) if bounds else F.lit(0)
    part = F.when(F.col("_id").isNull(), F.lit(len(bounds))).otherwise(part).cast("int")
    # at most one row for each part
    firsts = narrow.withColumn("_part", part).groupBy("_part").agg(F.max("_id").alias("_first")).collect()
    firsts = sorted(((r["_part"], r["_first"]) for r in firsts), key=lambda r: r[0])
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (p, at) in enumerate(firsts):
        first[p], before[p] = at, firsts[i - 1][0]
    rows = docs.select(F.col(id_col).alias("_own"), ids.alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_part", part)
    place = F.col("_part") + 1
    also = F.when(F.col("_id").eqNullSafe(F.element_at(listed(first, kind), place)), F.element_at(listed(before, "int"), place).cast("int"))
    return rows.withColumn("_also", also), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after this in descending order of the id, and the first
    one for the last; the edited text is this text with its last n_chars // 2 code points
    replaced by the first as many (or all) of the next one's. A null text counts as
    empty; ids that are no integers are ordered as strings, by bytes; a null id comes last, and rows of null ids are one part; repeated ids stand in the order of their texts; a single
    document is its own next one. An empty table gives an empty result; further columns
    are ignored. A task holds two texts at a time and the phrases of one.
    """
    rows, n = in_parts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    own = rows.select("_own", "_id", "_text", "_part", F.lit(False).alias("_extra"))
    # of rows with the first id of a part only the first in order may follow the part before; the others are dropped below
    extra = rows.where("_also is not null").select("_own", "_id", "_text", F.col("_also").alias("_part"), F.lit(True).alias("_extra"))
    order = [F.col("_part"), F.col("_extra"), F.col("_id").desc_nulls_last(), F.col("_text")]
    dealt = own.unionByName(extra).repartitionById(max(1, n), F.col("_part").cast("int")).sortWithinPartitions(*order)

    names = ["_own", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = finished = None  # the last row's id and text; a part whose last row has met its next one
        for batch in batches:
            kinds = [batch.schema.field("_own").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for at in range(0, batch.num_rows, 256):
                chunk, out = batch.slice(at, 256), []
                for own_id, text, part, spare in zip(*(chunk.column(c).to_pylist() for c in ("_own", "_text", "_part", "_extra"))):
                    if spare and finished == part:
                        continue
                    now = (own_id, held[1] if held and held[1].text == text else Parsed(text))
                    if held:
                        mine, changed = held[1], edit(held[1].text, text)
                        hashes = mine.edited(changed)
                        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((held[0], len(mine.text), digest, shown(mine.hashes), shown(hashes), likeness(mine.hashes, hashes), likeness(mine.hashes, now[1].hashes)))
                    held, finished = (None, part) if spare else (now, finished)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    out = dealt.mapInArrow(run, f"_own {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_own", id_col)

