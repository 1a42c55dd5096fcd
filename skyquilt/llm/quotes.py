"""Chat formatting by quotation linking.

Quote levels are parsed from the leading > marks of lines; each quoted passage is
normalised and hashed and joined to the message of the same conversation that first said
it; messages then stand in reply order, without their quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_total

MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: A line that announces a quote: it goes with the quote that follows.
INTRODUCES = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|écrit|escribió)\s?:\s*$", re.IGNORECASE)


def level_of(line: str) -> tuple[int, str]:
    """The quote level of a line, and the line without its marks."""
    found = MARKS.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def normal(text: str) -> str:
    """Lower case, with runs of white space as one space, and none at the ends."""
    return " ".join(text.lower().split())


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(normal(text)) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted passages (level, text) in order.

    A passage is a run of lines of one level; a line without words inside a quote ends it. Own
    text keeps its lines, less announcements of quotes and the blank lines around quotes.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = 0
    for line in (text or "").split("\n"):
        level, rest = level_of(line)
        if not level:
            own.append(line)
            open_level = 0
            continue
        if not open_level:
            while own and not own[-1].strip():
                own.pop()
            if own and INTRODUCES.match(own[-1]):
                own.pop()
        if rest.strip():
            if level == open_level and passages:
                passages[-1][1].append(rest)
            else:
                passages.append((level, [rest]))
            open_level = level
        else:
            open_level = -1  # still in a quote, in no passage
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def units(own: str) -> list[int]:
    """Hashes of what a quote may hold of a text: all of it, its paragraphs and its lines."""
    paragraphs = re.split(r"\n[ \t]*\n", own)
    return list({key_of(x) for x in [own, *paragraphs, *own.split("\n")] if x.strip()})


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, body, quotes: array of (level, n, key, lines), units."""
    source = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    quote = pa.struct([("level", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("lines", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, quotes, own = [], [], []
            for t in batch.column("text").to_pylist():
                body, passages = parse(t)
                bodies.append(body)
                quotes.append([{"level": level, "n": n, "key": key_of(p), "lines": [key_of(x) for x in p.split("\n")]} for n, (level, p) in enumerate(passages)])
                own.append(units(body))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(own, pa.list_(pa.int64()))], names=[*batch.schema.names, "body", "quotes", "units"])

    ddl = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, body string, quotes array<struct<level:int,n:int,key:bigint,lines:array<bigint>>>, units array<bigint>"
    return source.mapInArrow(run, ddl)


def roots(parents: DataFrame) -> DataFrame:
    """conv, turn, root: from (conv, turn, parent), by doubling the jumps until none moves; a parent is always earlier."""
    now = cut(parents.select("conv", "turn", F.col("parent").alias("root")))
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("up"))
        then = cut(now.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left").select("conv", "turn", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("_moved")), forget=True)
        if then.where("_moved").isEmpty():
            return then.select("conv", "turn", "root")
        now = then.select("conv", "turn", "root")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conv, turn, role, body, n_quotes, n_linked, parent_turn, root_turn, position.

    A quoted passage links to the earliest message of its conversation that has it, as
    its whole own text, a paragraph or a line, if that turn is before the quoting one; a
    passage found nowhere whole links by its lines. parent_turn is the turn that the
    shallowest linked quote leads to (the latest of several), root_turn the start of the
    chain of parents, and position counts a conversation's messages from 0 in the order
    of (root_turn, turn), so replies follow what they answer, thread by thread. Without
    linked quotes a message is its own root. A null text has an empty body; a null
    conversation is one of its own; a null turn is last and is no origin; messages that
    share a turn share its parent and stand in the order of role and body; an empty table
    gives an empty result; further columns are ignored.
    """
    rows = cut(parsed(messages, conv_col, turn_col, role_col, text_col))
    # one row for each conversation and unit: its first message
    said = rows.where("turn is not null").select("conv", "turn", F.explode("units").alias("key")).groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    quoted = rows.where("turn is not null").select("conv", "turn", F.explode("quotes").alias("q")).distinct()
    tries = quoted.select("conv", "turn", "q.level", "q.n", F.lit(0).alias("tier"), F.col("q.key").alias("key")).unionByName(
        quoted.where(F.size("q.lines") > 1).select("conv", "turn", "q.level", "q.n", F.lit(1).alias("tier"), F.explode("q.lines").alias("key"))
    )
    s = said.select(F.col("conv").alias("c"), F.col("key").alias("k"), "origin")
    found = tries.join(s, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("origin < turn")
    # of a passage the whole before its lines; of lines the latest origin
    links = found.groupBy("conv", "turn", "level", "n").agg(F.max(F.struct((-F.col("tier")).alias("t"), "origin"))["origin"].alias("origin"))
    parents = cut(links.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("l"), "origin"))["origin"].alias("parent")))
    chains = roots(parents).select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "root")
    p = parents.select(F.col("conv").alias("c1"), F.col("turn").alias("t1"), "n_linked", "parent")
    linked = p.join(chains, F.col("c1").eqNullSafe(F.col("c2")) & (F.col("t1") == F.col("t2"))).select("c1", "t1", "n_linked", "parent", "root")
    out = rows.join(linked, F.col("conv").eqNullSafe(F.col("c1")) & (F.col("turn") == F.col("t1")), "left")
    out = out.select("conv", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"))
    order = [F.col("conv").asc_nulls_first(), F.col("root_turn").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("body")]
    out = cut(running_total(out, order, F.lit(1), "_at"))
    first = out.groupBy("conv").agg(F.min("_at").alias("_first")).withColumnRenamed("conv", "_conv")
    out = out.join(first, F.col("conv").eqNullSafe(F.col("_conv"))).withColumn("position", F.col("_at") - F.col("_first"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", "n_quotes", "n_linked", "parent_turn", "root_turn", "position")
