"""Operator 9 [native]: sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard.  At each level every child draws a number from a hash of
the key and the child's name; -ln(draw) / weight is smallest for the chosen child, so children win in proportion to
their weights and a changed weight moves rows only into or out of that child's subtree.  A grown tree gets its new
shard in a region of its own: rows either stay or move to the new shard.

Cases: a null key is a key of its own ("null"); a null text has no bytes and size 1, like an empty one; very long texts
count with all their bytes; repeated rows get slots of their own; ties between draws go to the child listed first; an
empty table gives an empty result.  ``assign_shards`` keeps other columns untouched, whatever their names, and replaces
one named like its result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import global_rank, parts_for


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, base: int = 8) -> list[Leaf]:
    """``base`` shards in two regions of two racks; every further shard opens a region of its own."""
    first = [Leaf(f"region{i * 2 // base}", f"rack{i * 4 // base}", i) for i in range(min(shards, base))]
    return first + [Leaf(f"region-of-{i}", "rack0", i) for i in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; ties go to the child listed first."""
    if len(children) == 1:
        return children[0][2]
    return F.array_min(F.array(*[F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i"), value.alias("v")) for i, (name, weight, value) in enumerate(children)]))["v"]


def shard_column(key: Column, tree: list[Leaf]) -> Column:
    """The shard of ``key`` in ``tree`` as one column expression."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def level(leaves: list[Leaf], path: str, names: list[str]) -> Column:
        if not names:
            return _choose(key, [(f"{path}/{x.shard}", x.weight, F.lit(x.shard)) for x in leaves])
        groups: dict[str, list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(getattr(leaf, names[0]), []).append(leaf)
        return _choose(key, [(f"{path}/{g}", sum(x.weight for x in own), level(own, f"{path}/{g}", names[1:])) for g, own in groups.items()])

    return level(live, "", ["region", "rack"]).cast("int")


def assign_shards(df: DataFrame, key_col: str, tree: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(out, shard_column(F.col(key_col), tree))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Placement of every document under the ``key`` law, with its slot in the shard and its shard in a tree grown by one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_column(F.col("doc_id"), balanced_tree(shards)).alias("shard"),
        shard_column(F.col("doc_id"), balanced_tree(shards + 1)).alias("grown_shard"),
    )
    key = ["doc_id", "size", "text_crc32"]
    ranked = global_rank(placed, "shard", key, key, parts_for(docs.count() // shards))
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank").cast("long").alias("slot"), "grown_shard")
