"""Near-duplicate documents by a multi-index Hamming join of b-bit minwise signatures.

A document's set of word shingles gets a signature of 40 slots of 16 bits. Slots are
split into 10 chunks of 4, and each chunk is indexed under the 4 keys that leave one of its
slots out, so two signatures meet under some key whenever a chunk differs in at most one
slot; by pigeonhole that is so for every pair that differs in at most 19 slots. At
likeness 0.8 a pair differs in 8 slots on average, and all ten chunks differ in two or more
with probability 4e-8. Pairs that meet are confirmed on their full sets.

Equal sets are one class, and classes are what is compared. Every member of a key is first
held against the key's first one, and the links so found join most of a dense group without
its pairs being made. Only where a key still holds several components are its members
compared with each other, by size class and in blocks. Of those, only pairs of different
components go on to the full sets whose signatures are near and whose prefixes meet: in one
order of all shingles, with frequent ones last, sets of likeness t share one of their first
|x| - t |x| + 1 shingles. That drops documents which share a common passage and little else,
and loses no link. A key with so many members that their blocks would be many is dealt by
the shingles of these prefixes instead, so that only members that share one are compared.
Each pair goes on from the first of the keys, and of the prefix shingles, that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of

CHUNKS, PER_CHUNK = 10, 4
SLOTS = CHUNKS * PER_CHUNK
#: Differing slots from which a pair is not held against its full sets; above what the keys guarantee.
FAR = 23
#: Members of a cell that are compared with each other; ids that are broadcast at most.
BLOCK, BROADCAST_IDS = 1024, 1_000_000
#: Blocks of a cell beyond which it is dealt by prefix shingles. Blocks copy a member once each; shingles copy it through three shuffles for each of a fifth of its words, which is less from about a hundred blocks on. Both compare all that can be alike.
BLOCKS = 128
#: Documents of the sample that orders shingles by frequency (results do not depend on it), and documents of it that make a shingle frequent.
SAMPLE, FREQUENT = 2000, 8

U = np.uint64
_draw = np.random.default_rng(20240229)
TIMES = _draw.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * U(2) + U(1)
FLIP = _draw.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
PLACE = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """BASE to the i and to the -i modulo 2^64, for as many i as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n - 1, BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64))])
        return self.up, self.down


def shingle_sets(texts: list[str | None], width: int, powers: Powers) -> list[np.ndarray]:
    """Each text's set of word shingles, as sorted 64-bit hashes.

    Words are lower-cased in A-Z; fewer than `width` words make one shingle, none an empty set.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    if not len(data):
        return out
    blank = SPACE[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers.get(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)])])
    words = mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    # the first word of each text, and one past its last
    bounds = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    if len(words) >= width:
        n = len(words) - width + 1
        rolled = words[:n] * PLACE[0]
        for k in range(1, width):
            rolled = rolled + words[k : k + n] * PLACE[k]
        rolled = mixed(rolled)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b - a >= width:
            out[i] = np.unique(rolled[a : b - width + 1])
        elif b > a:
            out[i] = mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + U(int(b - a)))
    return out


def in_chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of up to 256 rows and about `most` bytes of text; a longer text is a slice of its own."""
    sizes = [len(x) if x else 0 for x in batch.column(column).to_pylist()]
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and (total + size > most or i - at >= 256):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield batch.slice(at)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """For non-empty sets: rows of SLOTS 16-bit values, each drawn from the smallest hash of the set under the slot's permutation."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SLOTS), np.uint16)
    for j in range(SLOTS):
        out[:, j] = (np.minimum.reduceat((flat ^ FLIP[j]) * TIMES[j], starts) * U(BASE)) >> U(48)
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """A hash of a set in 128 bits."""
    if not len(s):
        return 0, 0
    return int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(s * TIMES[0])).view(np.int64))


def frequent_shingles(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents of a sample, sorted, and how many hold each; at most SAMPLE / FREQUENT times the mean set of them."""
    ids = docs.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).collect()[0]["h"]
    # equal ids fall in together, so the sample is counted once more
    few = docs.where(F.xxhash64(id_col) <= F.lit(ids)).limit(2 * SAMPLE).select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in in_chunks(batch, "text"):
                    for s in shingle_sets(part.column("text").to_pylist(), width, powers):
                        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    rows = few.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    s, n = rows["s"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix(s: np.ndarray, percent: int, known: np.ndarray, counts: np.ndarray) -> bytes:
    """The first shingles of a set that a set of enough likeness must meet, in 32 bits each."""
    need = len(s) - -(-percent * len(s) // 100) + 1
    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
    often = known[at] == s if len(known) else np.zeros(len(s), bool)
    first = s[~often][:need]
    if len(first) < need:
        rest = s[often]
        first = np.concatenate([first, rest[np.lexsort((rest, counts[at[often]]))][: need - len(first)]])
    return (first >> U(32)).astype(">u4").tobytes()


def sketched(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc, h (a hash of the text), n (set size), s1 and s2 (a 128-bit hash of the set), sig and prefix (null for an empty set)."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).select("doc", F.xxhash64("text").alias("h"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    known, counts = frequent_shingles(docs, width, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in in_chunks(batch, "text"):
                    sets = shingle_sets(part.column("text").to_pylist(), width, powers)
                    full = [s for s in sets if len(s)]
                    sigs = iter(signature(full)) if full else iter(())
                    s1, s2 = zip(*map(set_hash, sets))
                    sig = [next(sigs).tobytes() if len(s) else None for s in sets]
                    first = [prefix(s, percent, known, counts) if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), pa.array(first, pa.binary())],
                        names=["doc", "h", "n", "s1", "s2", "sig", "prefix"],
                    )

    return source.mapInArrow(run, f"doc {kind}, h long, n long, s1 long, s2 long, sig binary, prefix binary")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """The CHUNKS * PER_CHUNK keys of each signature: three slots of a chunk, and which three."""
    out = []
    for c in range(CHUNKS):
        for left_out in range(PER_CHUNK):
            key = np.full(len(sigs), c * PER_CHUNK + left_out, np.int64)
            for j in range(PER_CHUNK):
                if j != left_out:
                    key = (key << 16) | sigs[:, c * PER_CHUNK + j].astype(np.int64)
            out.append(key)
    return np.stack(out, axis=1)


def keyed(reps: DataFrame) -> DataFrame:
    """key, rep: each class under its chunk keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS))
                own = part.column("rep").take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), own], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose signatures differ in fewer than FAR slots."""
    a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "a").join(b, "b").where("5 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) < FAR))

    return both.mapInArrow(run, "a long, b long")


def with_ids(rows: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Semi or anti join to `ids`, which are broadcast only if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b) of classes, those with 100 * intersection >= percent * union of their full sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "doc", "s1", "s2"), "rep"))
    source = with_ids(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), wanted.select("doc").distinct(), "doc", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in in_chunks(batch, "text"):
                    found = shingle_sets(part.column("text").to_pylist(), width, powers)
                    s1, s2 = zip(*map(set_hash, found))
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc", "s1", "s2", "set"])

    # an id may be repeated with the same set, or stand for other ones too; both uses below share one shuffle of the sets
    found = source.mapInArrow(sets, f"doc {kind}, s1 long, s2 long, set binary")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    known = found.join(F.broadcast(wanted) if few else wanted, ["doc", "s1", "s2"]).select("rep", "set").dropDuplicates(["rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(known.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(known.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep, component (the smallest one that links lead to) of all in links (a, b).

    By large-star and small-star steps in turn: each hangs neighbours on the smallest one
    by an aggregate and a join, so a hub's neighbours never meet in one task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if mark == state or not mark["n"]:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("rep"), "component").unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct())
        state = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), forget=True)


def overlap_bound(x: bytes, n: int, others: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most that a set's overlap with each other one can be, from their prefixes: what follows their first common shingle, none if there is none; and that shingle (as `cross_pairs` numbers it), or -2."""
    length = np.array([len(o) // 4 for o in others])
    mine, flat = np.frombuffer(x, ">u4"), np.frombuffer(b"".join(others), ">u4")
    order = np.argsort(mine, kind="stable")
    place = order[np.minimum(np.searchsorted(mine, flat, sorter=order), len(mine) - 1)]
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    index = np.arange(len(flat)) - np.repeat(starts, length)
    none = np.int64(1 << 40)
    hit = mine[place] == flat
    # prefixes are in one order, so the first common shingle is the first in both
    first = np.minimum.reduceat(np.where(hit, place, none), starts)
    left = np.minimum(n - first, sizes - np.minimum.reduceat(np.where(hit, index, none), starts))
    return np.maximum(left, 0), np.where(first < none, mine[np.minimum(first, len(mine) - 1)].astype(np.int64), -2)


def _by_token(rows: DataFrame, hot: Column) -> DataFrame:
    """Rows of cells with a token: -1 outside hot cells; in them a row for each prefix shingle that other components have too, and the members that share it."""
    every = ["key", "cell", "token", "members", "rep", "component", "size_class", "n", "sig", "prefix"]
    # the shingles alone are counted first, so that only shared ones are sent on with signatures
    at = F.sequence(F.lit(0), (F.octet_length("prefix") / 4 - 1).cast("int"))
    token = F.transform(at, lambda i: F.conv(F.hex(F.substring("prefix", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    named = rows.where(hot).select("key", "cell", "rep", "component", F.explode(F.array_distinct(token)).alias("token"))
    shared = named.groupBy("key", "cell", "token").agg(F.count("*").alias("members"), F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least != _most").select("key", "cell", "token", "members")
    met = named.select("key", "cell", "rep", "token").join(shared, ["key", "cell", "token"])
    tokens = met.join(rows.where(hot).drop("members"), ["key", "cell", "rep"]).select(*every)
    return rows.where(~hot).withColumn("token", F.lit(-1).cast("long")).select(*every).unionByName(tokens)


def cross_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key, have near signatures and meeting prefixes.

    members: key, rep, component. Under a key, sets are put by size into classes of ratio
    1.25; a pair that can be alike lies in one class or in neighbouring ones. Each
    (key, class) is a cell; a large one is cut into blocks, and each two blocks make a cell.
    A cell of more than BLOCKS blocks is dealt by the shingles of its members' prefixes,
    and only where very many share one are they cut into blocks again.
    """
    rows = members.join(reps.select("rep", "n", "sig", "prefix"), "rep").withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    rows = rows.withColumn("cell", F.explode(F.array("size_class", F.col("size_class") + 1)))
    sizes = rows.groupBy("key", "cell").agg(F.count("*").alias("members"), F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least != _most")
    sizes = cut(sizes.select("key", "cell", "members"))
    rows = rows.join(sizes, ["key", "cell"])
    hot = F.col("members") > BLOCK * BLOCKS
    if sizes.where(hot).isEmpty():
        rows = rows.withColumn("token", F.lit(-1).cast("long"))
    else:
        rows = _by_token(cut(rows), hot)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "cell", "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "size_class", "n", "sig", "prefix")
    group = ["key", "cell", "token", "i", "j"]
    dealt = rows.repartition(parts_of(rows.sparkSession), *group).sortWithinPartitions(*group, "rep")

    def compare(rows: list[tuple]) -> list[tuple]:
        block, rep, component, size_class, n, sig, first, names = zip(*rows)
        key, cell, token, i, j = names[0]
        if len(set(component)) == 1:
            return []
        seen: dict = {}
        label = np.array([seen.setdefault(c, len(seen)) for c in component])
        sigs, block, size_class, n = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SLOTS), np.array(block), np.array(size_class), np.array(n)
        found = []
        for x in range(len(rows) - 1):
            rest = slice(x + 1, None)
            # a pair is compared in the cell of its larger class, and in the cell of its blocks
            can = (label[rest] != label[x]) & (np.maximum(size_class[rest], size_class[x]) == cell) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
            if i != j:
                can &= block[rest] != block[x]
            at = np.flatnonzero(can) + x + 1
            if not len(at):
                continue
            # and under the first of the keys that it shares
            differ = (sigs[at] != sigs[x]).reshape(-1, CHUNKS, PER_CHUNK)
            wrong = differ.sum(axis=2)
            chunk = (wrong <= 1).argmax(axis=1)
            within = differ[np.arange(len(at)), chunk]
            at = at[(chunk * PER_CHUNK + within.argmax(axis=1) == key >> 48) & (wrong.sum(axis=1) < FAR)]
            if len(at):
                bound, meet = overlap_bound(first[x], n[x], [first[y] for y in at], n[at])
                goes = bound * (100 + percent) >= percent * (n[x] + n[at])
                if token >= 0:
                    goes &= meet == token
                found += [(rep[x], rep[y]) for y in at[goes].tolist()]  # rows are in the order of rep
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for *name, block, rep, component, size_class, n, sig, first in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "token", "i", "j", "block", "rep", "component", "size_class", "n", "sig", "prefix"))):
                if group and group[-1][7] != name:
                    out += compare(group)
                    group = []
                group.append((block, rep, component, size_class, n, sig, first, name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        if group and (out := compare(group)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def placed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc, h, n, component (the smallest doc of the row's group) and first (whether the row is the group's one to stay)."""
    rows = cut(sketched(docs, width, percent, id_col, text_col))
    kin = rows.where("n > 0 and doc is not null")
    # an id may be repeated with other texts, so sets have numbers of their own
    classes = kin.groupBy("s1", "s2").agg(F.min(F.struct("doc", "h")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    # numbered in the order of their documents, so that a key's first member is the earliest, often what the others were made from
    dealt = classes.repartitionByRange(parts_of(docs.sparkSession), "least").sortWithinPartitions("least")
    reps = cut(dealt.withColumn("doc", F.col("least.doc")).withColumn("rep", F.monotonically_increasing_id()))
    keys = keyed(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("_c"), F.min("rep").alias("first")).where("_c > 1").select("key", "first")
    members = cut(keys.join(shared, "key"))

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(confirmed(cut(pairs), reps, docs, width, percent, id_col, text_col))

    stars = linked(near(members.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), reps))
    joined = cut(components(stars))
    at = members.join(joined, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    rest = linked(cross_pairs(at, reps, percent))
    groups = cut(reps.select("rep", "s1", "s2", "least").join(components(stars.unionByName(rest)), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    lowest = groups.groupBy("component").agg(F.min("least").alias("lowest"))
    known = groups.join(lowest, "component").select("s1", "s2", "lowest")
    own = (F.col("n") == 0) | F.col("doc").isNull()
    out = rows.join(known, ["s1", "s2"], "left")
    component = F.when(own, F.col("doc")).otherwise(F.col("lowest.doc"))
    first = own | ((F.col("doc") == F.col("lowest.doc")) & (F.col("h") == F.col("lowest.h")))
    return out.select("doc", "h", "n", component.alias("component"), first.alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_shingles, component_id, kept.

    Documents link whose shingle sets have a likeness of at least `percent` hundredths;
    component_id is the smallest id that links lead to, and kept marks that document. A
    document without words (or null text) links with nothing. A null id links with
    nothing, has a null component and is kept. Equal rows get equal results; rows that
    repeat an id with other texts are placed by their own text. An empty table gives an
    empty result; further columns are ignored.
    """
    out = placed(docs, width, percent, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of `near_duplicates`, with all its columns: that of the smallest id.

    Documents are told apart by id and text, so other texts under the same id have groups
    of their own or the same one; of the texts of a group's smallest id one stays, and of
    rows with the same id and text one (the first by a hash of the row). Documents without
    words and null ids stay as they are, repeated or not. An empty table stays empty.
    """
    every = cut(placed(docs, width, percent, id_col, text_col).select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), "first", "n"))
    gone = every.where("not first").select("_doc", "_h").distinct()
    again = every.where("first and n > 0 and _doc is not null").groupBy("_doc", "_h").count().where("count > 1").select("_doc", "_h")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_h"))
    left = with_ids(with_ids(rows, gone, ["_doc", "_h"], "left_anti"), again, ["_doc", "_h"], "left_anti").select("_row")
    one = with_ids(rows, again, ["_doc", "_h"], "left_semi").groupBy("_doc", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return left.unionByName(one).select("_row.*")
