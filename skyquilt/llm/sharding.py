"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard; at each level every child draws
``-ln(u) / weight`` with ``u`` from a hash of the key and the child's path, and the
smallest draw wins. A child's share is its weight, and when weights change, rows move
only within the nodes whose children changed: a new region draws rows to itself only, and
a heavier rack takes rows from its sister racks only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_totals, cut

#: A node is (name, weight, children); a leaf's children are its shard number.
Node = tuple[str, float, "list[Node] | int"]


def uniform_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Node]:
    """Shards 0 to `shards` - 1 in racks and regions of fixed size, weight 1 a shard.

    Where the last region is full, one more shard opens a region of its own, so that rows
    move only into it; otherwise they also move inside the last region.
    """
    tree: list[Node] = []
    for r0 in range(0, shards, per_rack * racks):
        inner = []
        for k0 in range(r0, min(r0 + per_rack * racks, shards), per_rack):
            leaves: list[Node] = [(f"s{i}", 1.0, i) for i in range(k0, min(k0 + per_rack, shards))]
            inner.append((f"k{k0 // per_rack}", float(len(leaves)), leaves))
        tree.append((f"r{r0 // (per_rack * racks)}", sum(x[1] for x in inner), inner))
    return tree


def _uniform(key: Column, path: Column) -> Column:
    """In (0, 1), from 52 bits of a hash of the key and the node's path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _flat(tree: list[Node]) -> tuple[list[list[dict]], int]:
    """The tree as lists of children by node number (the root is 1), and its depth; leaves are minus shard - 1."""
    nodes: list[list[dict]] = [[]]

    def walk(at: int, children: list[Node], path: str) -> int:
        depth = 1
        for name, weight, below in children:
            here = f"{path}/{name}"
            if isinstance(below, int):
                nodes[at].append({"path": here, "weight": float(weight), "node": -below - 1})
                continue
            nodes.append([])
            nodes[at].append({"path": here, "weight": float(weight), "node": len(nodes)})
            depth = max(depth, 1 + walk(len(nodes) - 1, below, here))
        return depth

    depth = walk(0, tree, "")
    return nodes, depth


def place(df: DataFrame, key: str, tree: list[Node], name: str) -> DataFrame:
    """Add `name`, the shard of the string column `key` in `tree`: at each level the child with the smallest draw."""
    nodes, depth = _flat(tree)
    known = F.from_json(F.lit(json.dumps(nodes)), "array<array<struct<path:string,weight:double,node:int>>>")
    df = df.withColumn(name, F.lit(1))
    for _ in range(depth):
        draws = F.transform(F.element_at(known, F.col(name)), lambda c: F.struct((-F.log(_uniform(F.col(key), c["path"])) / c["weight"]).alias("d"), c["node"].alias("node")))
        df = df.withColumn(name, F.when(F.col(name) < 0, F.col(name)).otherwise(F.array_min(draws)["node"]))
    return df.withColumn(name, (-F.col(name) - 1).cast("int"))


def shard(docs: DataFrame, tree: list[Node], grown: list[Node] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document; columns `id_col`, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; slot counts a shard's rows from 0 without gaps,
    in the order of the id's hash. A null text has no bytes, a null id counts as the empty
    key, repeated ids share a shard and differ by slot; an empty table gives an empty
    result, and columns besides the two named are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), key.alias("_k"))
    base = place(base, "_k", tree, "shard")
    base = place(base, "_k", grown, "grown_shard") if grown else base.withColumn("grown_shard", F.lit(None).cast("int"))
    base = cut(base.withColumn("_h", F.md5("_k")).withColumn("_b", F.substring("_h", 1, 2)))
    starts = bucket_totals(base, ["shard"], "_b", F.lit(1), "_start")
    order = Window.partitionBy("shard", "_b").orderBy("_h", F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    slots = base.withColumn("_n", F.row_number().over(order)).join(starts, ["shard", "_b"])
    return slots.select(id_col, "size", "text_crc32", "shard", (F.col("_n") - 1 + F.col("_start")).cast("long").alias("slot"), "grown_shard")
