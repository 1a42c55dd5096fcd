"""How the words of each source differ from those of its language and of its other sources.

Every divergence is a sum of f = floor((p - q)^2 / q) over terms, with p and q scaled integer
shares, all exact. Pairs of sources come from postings: a term adds to a pair only if both
sources have it, and the rest follows from how often each share occurs in each source. The
terms that a source has too often are searched by upper bounds: a source's terms are bucketed
by count, the largest share and the smallest share in the language bound f in a bucket, and
buckets are opened best first until no closed one can reach the k-th value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, stored

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 3
TOP = 200
#: Tables of so many rows at most are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Entries that a task holds before it passes them on.
HELD = 400_000
#: Bytes of a term stay, A to Z in lower case; all others part terms.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and the documents with it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        new = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                terms = text.as_py().translate(_FOLDED).split()
                own = set(terms)
                new += len(own)
                n.update(terms)
                docs.update(own)
                if new > HELD:
                    yield from out(held)
                    held, new = {}, 0
        yield from out(held)

    each = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return each.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 * (count + 1) / total) for count < total, three digits at a time, so that nothing overflows below 9 * 10^15."""
    rest, out = f"({count} + 1L)", "0L"
    for _ in range(3):
        out = f"({out} * 1000L + ({rest} * 1000L) div ({total}))"
        rest = f"(({rest} * 1000L) % ({total}))"
    return F.expr(f"CASE WHEN ({total}) > 0 THEN 1L + {out} END")


def excess(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def groups_and_shares(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, size, terms, vocabulary, lang_size, zero) and shares (lang, source, term, n, p, q).

    `size` counts the occurrences of kept terms, `terms` the kept terms that occur, and `zero` is
    the share of one that does not occur. Shares have the kept terms that occur in a group.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    per_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    postings = stored(per_term.where(F.col("docs") >= least_docs).drop("docs"))
    entries = postings.select("lang", "term", "lang_n", F.explode("entries").alias("e")).select("lang", "e.source", "term", "e.n", "lang_n")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sizes = entries.groupBy(*_GROUP).agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    langs = postings.groupBy("lang").agg(F.sum("lang_n").alias("lang_size"), F.count("*").alias("vocabulary"))
    groups = named.join(sizes, _GROUP, "left").join(langs, "lang", "left").na.fill(0)
    groups = cut(groups.withColumn("zero", share("0L", "size + vocabulary")))
    shares = attach(entries, groups, _GROUP, ["size", "vocabulary", "lang_size"], "terms")
    return groups, stored(shares.select(*_GROUP, "term", "n", share("n", "size + vocabulary").alias("p"), share("lang_n", "lang_size + vocabulary").alias("q")))


def _common(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: over the terms that both have, f less what the terms of either would give against one that is absent, plus f of two absent ones."""
    with_zero = attach(shares, groups, _GROUP, ["zero"], "terms")
    postings = with_zero.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("e")).select("lang", "e")

    def out(held: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
        keys = list(zip(*held)) if held else [(), (), ()]
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], pa.array(list(held.values()), pa.int64())], names=["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            names = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes), pa.string()).dictionary_encode()
            sources = flat.field(0).dictionary_encode()
            lang, source = names.indices.to_numpy(), sources.indices.to_numpy()
            p, z = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            partners = np.repeat(sizes, sizes)
            done = np.cumsum(partners)
            langs, known = names.dictionary.to_pylist(), sources.dictionary.to_pylist()
            at = 0
            while at < len(p):
                # about a million pairs at a time, one entry's at least
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 1_000_000)))
                a = np.repeat(np.arange(at, to), partners[at:to])
                b = np.arange(len(a)) - np.repeat(np.cumsum(partners[at:to]) - partners[at:to], partners[at:to]) + first[a]
                a, b = a[a != b], b[a != b]
                f = (p[a] - p[b]) ** 2 // p[b] - (p[a] - z[b]) ** 2 // z[b] - (z[a] - p[b]) ** 2 // p[b] + (z[a] - z[b]) ** 2 // z[b]
                code = (lang[a].astype(np.int64) * len(known) + source[a]) * len(known) + source[b]
                order = np.argsort(code, kind="stable")
                code = code[order]
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])[: len(code)]
                for c, v in zip(code[starts].tolist(), np.add.reduceat(f[order], starts).tolist() if len(starts) else []):
                    key = (langs[c // len(known) ** 2], known[c // len(known) % len(known)], known[c % len(known)])
                    held[key] = held.get(key, 0) + v
                at = to
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        yield out(held)

    return postings.mapInArrow(run, "lang string, source string, item string, value long")


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value: for each group and each other source of its language, f summed over all kept terms, with the other's share as q."""
    other = _small(groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_2"), F.col("terms").alias("terms_2")))
    apart = F.col("source") != F.col("item")
    pairs = groups.join(other, "lang").where(apart)
    absent = F.when(F.col("vocabulary") > 0, (F.col("vocabulary") - F.col("terms") - F.col("terms_2")) * excess("zero", "zero_2")).otherwise(0)
    levels = cut(shares.groupBy(*_GROUP, "p").agg(F.count("*").alias("c")))
    facing = levels.join(other, "lang").where(apart)
    own = facing.select(*_GROUP, "item", (F.col("c") * excess("p", "zero_2")).alias("value"))
    theirs = facing.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("c") * excess("zero_2", "p")).alias("value"))
    both = _common(shares, groups)
    parts = pairs.select(*_GROUP, "item", absent.cast("long").alias("value")).unionByName(own).unionByName(theirs).unionByName(both)
    return parts.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("value").desc(), F.col("term")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order))).where(F.col("rank") <= k)


def frequent_terms(shares: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, term, value, rank: for each group the k terms of largest f among those with a share above the language's.

    Buckets are opened in waves, best bound first, each wave with about as many terms as all
    before it, and a group is done when the k-th value is above the bounds of all its closed ones.
    """
    bucketed = shares.withColumn("bucket", F.floor(F.log2("n") * 8).cast("int"))
    buckets = bucketed.groupBy(*_GROUP, "bucket").agg(F.max("p").alias("p_most"), F.min("q").alias("q_least"), F.count("*").alias("terms"))
    # a bucket whose shares are all at most the least one of the language has nothing to give
    buckets = buckets.where("p_most > q_least").withColumn("bound", excess("p_most", "q_least"))
    earlier = Window.partitionBy(*_GROUP).orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("terms").over(earlier), F.lit(0))
    buckets = cut(buckets.withColumn("wave", F.when(before < k, 0).otherwise(F.floor(F.log2(before / k)) + 1).cast("int")))
    dealt = attach(bucketed, buckets, [*_GROUP, "bucket"], ["wave"], "terms").where("wave is not null")
    dealt = stored(dealt.select(*_GROUP, "term", "p", "q", "wave"), "wave")
    best = going = None
    # at most one wave for each doubling of the vocabulary
    for wave in sorted(r[0] for r in buckets.select("wave").distinct().collect()):
        opened = dealt.where(F.col("wave") == wave)
        if going is not None:
            opened = opened.join(_small(going), _GROUP, "left_semi")
        found = opened.where("p > q").select(*_GROUP, "term", excess("p", "q").alias("value"))
        # a hot group's terms are ranked in shares first
        some = Window.partitionBy(*_GROUP, "_salt").orderBy(F.col("value").desc(), "term")
        found = found.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(256))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("_salt", "rank")
        best = cut(_best(found if best is None else best.drop("rank").unionByName(found), k))
        closed = buckets.where(F.col("wave") > wave).groupBy(*_GROUP).agg(F.max("bound").alias("bound"))
        going = cut(closed.join(best.where(F.col("rank") == k).select(*_GROUP, "value"), _GROUP, "left").where("value is null or bound >= value").select(*_GROUP))
        if going.isEmpty():
            break
    if best is None:
        return shares.select(*_GROUP, "term", F.col("p").alias("value"), F.lit(1).alias("rank")).where("false")
    return best


def audit(docs: DataFrame, k: int = TOP, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair` has each other source of the language, part `term` the k terms that a source
    has more than its language does; ranks go by value, then by item. Null texts, languages and sources
    are empty ones; every row is a document; a group without kept terms has pairs only, of value 0 if its
    language has none; an empty table gives an empty result. Columns other than these three are not looked at.
    """
    groups, shares = groups_and_shares(docs, least_docs, text_col, lang_col, source_col)
    ranked = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(groups, shares).withColumn("rank", F.row_number().over(ranked)).select(*_GROUP, F.lit("pair").alias("part"), "item", "value", "rank")
    terms = frequent_terms(shares, k).select(*_GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
