"""URL filters: exact membership in a list by a cascade of Bloom filters.

Level 1 encodes the listed keys. Keys of the corpus that are not listed and yet pass go
into level 2, listed keys that pass level 2 go into level 3, and so on, until nothing
passes wrongly. Over the complete key universe of the corpus the first level that a key
fails tells exactly whether it is listed, so pages are judged by bit tests alone. A list
whose filter is too large for one row has its keys parted by hash into segments, each with
filters of its own, and a key is tested in those of its segment. Only DataFrame functions
are used.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of

#: Rules by host suffix and path prefix.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Bits for a key and hash functions; bits of a segment of a level at most; bits of all segments together that are broadcast at most.
BITS, HASHES, MOST_BITS, BROADCAST_BITS = 10, 7, 1 << 26, 1 << 28


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def by_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """The HASHES bits of a key in a level, by double hashing."""
    step = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    start = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    return [F.pmod(start + i * step, F.lit(bits)) for i in range(HASHES)]


def encoded(keys: DataFrame, level: int, bits: int, segments: int) -> DataFrame:
    """segment, words: the level's bits over the keys (segment, key) of each segment, as longs."""
    at = keys.select("segment", F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy("segment", F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    each = bits // 64
    every = keys.sparkSession.range(segments * each).select(F.expr(f"id div {each}").cast("int").alias("segment"), (F.col("id") % each).cast("int").alias("word")).join(words, ["segment", "word"], "left")
    inside = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.groupBy("segment").agg(F.transform(inside, lambda x: x["bits"]).alias("words"))


def passes(key: Column, words: Column, level: int, bits: int) -> Column:
    tests = [F.getbit(F.element_at(words, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, level, bits)]
    return reduce(and_, tests)


def segment_of(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(segments)).cast("int")


class Cascade:
    """The levels of a filter: a table (segment, words) and a number of bits for each."""

    def __init__(self, segments: int) -> None:
        self.segments, self.tables, self.bits = segments, [], []  # type: ignore[var-annotated]

    def add(self, inside: DataFrame) -> None:
        """Encode keys (segment, key) as the next level; its segments are of one size, that of the fullest."""
        fullest = inside.groupBy("segment").count().agg(F.max("count")).collect()[0][0]
        bits = -(-fullest * BITS // 64) * 64
        self.tables.append(cut(encoded(inside, len(self.tables), bits, self.segments)))
        self.bits.append(bits)

    def with_words(self, rows: DataFrame, levels: list[int]) -> tuple[DataFrame, list[Column]]:
        """Rows (with `segment`) and each level's words in their segment: constants where there is one segment, else a column."""
        if self.segments == 1:
            return rows, [self.tables[k].select("words").scalar() for k in levels]
        words = reduce(lambda a, b: a.join(b, "segment"), [self.tables[k].withColumnRenamed("words", f"_words_{k}") for k in levels])
        if self.segments * sum(self.bits[k] for k in levels) <= BROADCAST_BITS:
            rows = rows.join(F.broadcast(words), "segment")
        else:
            # rows go to the words of their segment, which have a copy for each share of it
            shares = -(-parts_of(rows.sparkSession) // self.segments)
            copies = words.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            dealt = rows.withColumn("_share", F.pmod(F.xxhash64("_key", F.monotonically_increasing_id()), F.lit(shares)).cast("int"))
            rows = dealt.join(copies.hint("shuffle_hash"), ["segment", "_share"])
        return rows, [F.col(f"_words_{k}") for k in levels]

    def passing(self, keys: DataFrame) -> DataFrame:
        """Of the keys (segment, key), those that pass the last level."""
        level = len(self.tables) - 1
        rows, words = self.with_words(keys.withColumn("_key", F.col("key")), [level])
        return rows.where(passes(F.col("_key"), words[0], level, self.bits[level])).select("segment", "key")

    def listed(self, rows: DataFrame) -> DataFrame:
        """Rows with `_key` and `_listed`: the first level that a key of the universe fails is an even one, counted from 1."""
        levels = list(range(len(self.tables)))
        if not levels:
            return rows.withColumn("_listed", F.lit(False))
        rows, words = self.with_words(rows.withColumn("segment", segment_of(F.col("_key"), self.segments)), levels)
        out = F.lit(len(levels) % 2 == 1)
        for level in reversed(levels):
            out = F.when(~passes(F.col("_key"), words[level], level, self.bits[level]), F.lit(level % 2 == 1)).otherwise(out)
        return rows.withColumn("_listed", out)


def cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """The cascade of a list (key, every key once) over a universe of keys (key, repeats allowed).

    The first level encodes the list alone. Only the keys of the universe that pass it are
    compared with the list, to tell which of them are not in it; further levels encode, in
    turn, what passes wrongly.
    """
    segments = max(1, -(-listed.count() * BITS // most_bits))
    dealt = lambda df: df.select(segment_of(F.col("key"), segments).alias("segment"), "key")
    inside = cut(dealt(listed))
    out = Cascade(segments)
    if inside.isEmpty():
        return out
    out.add(inside)
    # a small part of the universe: the listed keys that occur, and one in 2^HASHES others
    passing = out.passing(dealt(universe)).distinct()
    inside, outside = cut(passing.join(inside, ["segment", "key"], "left_anti")), inside
    while not inside.isEmpty():
        out.add(inside)
        inside, outside = cut(out.passing(outside)), inside
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, most_bits: int = MOST_BITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: `id_col`, host, path, rule, verdict.

    The longest rule that fits gives the verdict; where none fits, a page whose key (host
    and path) is in `listed` (a table with the column key) is blocked and any other allowed. A null URL
    or one without :// has an empty host and path, and so the empty key. Repeated pages
    get equal verdicts, repeated or null listed keys count once or not at all, empty tables give
    empty results, and further columns are ignored. A list that needs more than
    `most_bits` bits in a level has as many segments as it takes.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_key", F.concat("host", "path"))
    marked = listed.select("key").where("key is not null").distinct()
    rows = cascade(marked, rows.select(F.col("_key").alias("key")), most_bits).listed(rows)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_listed"), "block").otherwise("allow")
    return rows.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct keys of the pages."""
    host, path = host_and_path(F.col("_url"))
    return pages.select(F.col(url_col).cast("string").alias("_url")).select(F.concat(host, path).alias("key")).distinct()
