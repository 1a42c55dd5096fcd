"""Mixing sources to target weights by a time-varying curriculum.

Each source has a linear weight schedule over training time 0 to 1. Its integral is the
source's cumulative token demand; inverting that demand at a document's place in the
source's (repeated) stream gives the document's training position, and documents are
range-sorted by position. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_totals, cut, n_words, running_total

#: Weights given in turn to the sources by code point, and the most a source is repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Weight at time 0 and 1, in turn for the sources; each averages 1, so it moves positions, not totals.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _in_turn(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source: source, source_size, at (its turn), target.

    All sizes are shared by weight; a share over `most` times the source's size stops
    there and the excess goes to the others by weight. That is the level L with
    sum(min(most * size, L * weight)) = sum(size), found by a running total over the
    sources in order of most * size / weight. One row per source; no task sees them all.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = running_total(per, [F.col("source").asc_nulls_last()], F.lit(1), "at").withColumn("_w", _in_turn(weights, F.col("at")).cast("long"))
    per = cut(per.withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("_w")))
    per = running_total(per, ["_ratio", "at"], F.col("_cap"), "_cap_before")
    per = running_total(per, ["_ratio", "at"], F.col("_w"), "_w_before")
    whole = per.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_weights"))
    per = per.join(F.broadcast(whole))  # one row
    per = per.withColumn("_level", (F.col("_all") - F.col("_cap_before")) / (F.col("_weights") - F.col("_w_before")))
    per = per.withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    # after the first source below its cap the levels only fall
    level = per.where(~F.col("_capped")).agg(F.max("_level").alias("_final"))
    per = per.join(F.broadcast(level))  # one row
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final"))
    return per.select("source", "source_size", "at", target.alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """The time t at which a linear schedule from `start` to `end`, of mean 1, has used `share`."""
    slope = end - start
    root = (F.sqrt(start * start + 2 * slope * share) - start) / slope
    return F.when(slope == 0, share).otherwise(root)


def _placed(docs: DataFrame, weights: tuple, most: int, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    """A row for each of `docs`: _id, source, size, source_size, target, at, first_at, _words, taken, and with `whole` _row, the row itself.

    Rows are placed as they are and never matched by id, so ids may be repeated.
    """

    def sized(whole: bool) -> DataFrame:
        row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
        out = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("_text"), *row)
        return out.withColumn("_h", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))).withColumn("_b", F.substring("_h", 1, 3))

    narrow = cut(sized(False))
    goal = targets(narrow.select("source", "size"), weights, most)
    starts = bucket_totals(narrow, ["source"], "_b", F.col("size"), "_start")
    # per source and bucket; nulls match nulls
    levels = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("_source"), F.col("_b").alias("_bucket"), "_start", "source_size", "at", "target")
    levels = cut(levels)
    order = Window.partitionBy("source", "_b").orderBy("_h", F.col("_id").asc_nulls_first(), "size", "_text")
    rows = (sized(True) if whole else narrow).withColumn("_in", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(levels, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket")))
    words, size = F.round("target").cast("long"), F.col("source_size")
    rows = rows.withColumn("first_at", F.col("_in") + F.col("_start")).withColumn("_words", words)
    full = F.when(size > 0, F.expr("_words div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("_full", full).withColumn("_rest", F.col("_words") - F.col("_full") * size)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("first_at")))
    rows = rows.withColumn("taken", (F.col("_full") * F.col("size") + part).cast("long"))
    return rows.select("_id", "source", "size", "source_size", "target", "at", "first_at", "_words", "taken", *(["_row"] if whole else []))


def _time(share: Column) -> Column:
    """The training time at which a row's source has used `share` of its words."""
    return position(share, *[_in_turn(tuple(s[k] for s in SCHEDULES), F.col("at")) for k in (0, 1)])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: `id_col`, size, source, source_size, target, taken, first_at, position.

    size is the words of the text. A source's documents stand in the order of the id's
    hash; the mix takes the stream from its start, over and over, for round(target) words,
    so `taken` is size times the full passes plus what the last pass reaches: one document
    of a source may be taken in part. position is the training time of its first word,
    null if nothing of it is taken; the same rows give the same result. A null text has
    size 0, a null source is a source of its own that comes last, repeated ids are
    separate documents, an empty table gives an empty result; further columns are ignored.
    """
    rows = _placed(docs, weights, most, id_col, text_col, source_col, False)
    at = F.when(F.col("taken") > 0, _time(F.col("first_at") / F.col("_words")))
    return rows.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "taken", "first_at", at.alias("position"))


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Range-sort by training position; documents that the mix leaves out come last."""
    order = [F.col("position").asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_rows(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: a row for each time one is taken, range-sorted by position.

    Columns are those of `docs`, whatever their names; a document taken in part on its last
    time is cut after the last word taken (with n_chars, if there is such a column, set
    anew). Documents without words are never taken. Rows that share an id, and equal rows,
    are documents of their own: none is taken more than `most` times.
    """
    rows = _placed(docs, weights, most, id_col, text_col, source_col, True).where("taken > 0")
    turns = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.expr("(taken - 1) div size").cast("int"))))
    turns = turns.withColumn("_time", _time((F.col("first_at") + F.col("_turn") * F.col("source_size")) / F.col("_words")))
    left = F.least(F.col("size"), F.col("taken") - F.col("_turn") * F.col("size")).cast("int")
    turns = turns.select("_row", "_id", "_turn", "_time", F.when(left < F.col("size"), left).alias("_left"))
    order = [F.col("_time"), F.col("_id").asc_nulls_last(), F.col("_turn")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    text = F.col(f"_row.`{text_col}`")
    # pieces that each end with a word; together they are the text
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut_text = F.when(F.col("_left").isNull(), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.coalesce(F.col("_left"), F.lit(1))), ""))
    made = {text_col: cut_text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("_left").isNull(), F.col("_row.n_chars")).otherwise(F.char_length(cut_text).cast("long"))
    return dealt.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


__all__ = ["MOST", "SCHEDULES", "WEIGHTS", "WORD", "by_position", "mix", "position", "targets", "training_rows"]
