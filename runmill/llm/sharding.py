"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A topology has three levels: regions, racks and shards.  A key descends from
the root; at each node every child draws ``-ln(u) / weight`` from a hash of the
key and the child's path, and the smallest draw wins.  A child's weight is the
sum of its shards' weights, so a key reaches a shard with a probability in
proportion to the shard's weight.  When the weight of one subtree grows, its
own draw shrinks and no other draw changes: keys move only into that subtree
(and out of a subtree whose weight falls), and inside every other subtree
nothing moves.  ``grown`` adds capacity as a region of its own, so every row
that moves lands on the new shard.

Cases: a null doc_id is a key like any other and always lands on one shard; a
null text counts as no bytes (size 1, CRC 0); repeated rows go to one shard and
get different slots; an empty table gives an empty result; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a shard are numbered bucket by bucket; so many buckets bound the table of offsets at shards * BUCKETS rows.
BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(regions: int = 2, racks: int = 2, shards: int = 2) -> tuple[Leaf, ...]:
    """A regular tree; shards are numbered from 0 through all racks."""
    return tuple(Leaf(g, g * racks + r, (g * racks + r) * shards + s) for g in range(regions) for r in range(racks) for s in range(shards))


def grown(leaves: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """One more shard, as a new region with one rack."""
    return (*leaves, Leaf(1 + max(x.region for x in leaves), 1 + max(x.rack for x in leaves), 1 + max(x.shard for x in leaves), weight))


def _draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child whose weighted hash draw is the smallest."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = []
    for child, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}:{child}"), key), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def shard_of(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """Descend region, rack and shard level for a key column."""
    if not leaves or any(not x.weight > 0 for x in leaves):
        raise ValueError("a topology needs shards, all of positive weight")
    if len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("shard numbers must differ")

    def weights(level: str, among: list[Leaf]) -> dict[int, float]:
        out: dict[int, float] = {}
        for x in among:
            out[getattr(x, level)] = out.get(getattr(x, level), 0.0) + x.weight
        return out

    def descend(levels: tuple[str, ...], among: list[Leaf], path: str) -> Column:
        level, rest = levels[0], levels[1:]
        children = weights(level, among)
        won = _draw(key, f"{path}/{level}", children)
        if not rest:
            return won
        out = None
        for child in sorted(children):
            below = descend(rest, [x for x in among if getattr(x, level) == child], f"{path}/{child}")
            out = below if len(children) == 1 else F.when(won == child, below) if out is None else out.when(won == child, below)
        return out

    return descend(("region", "rack", "shard"), list(leaves), "")


def shard_documents(docs: DataFrame, leaves: tuple[Leaf, ...] | None = None, more: tuple[Leaf, ...] | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    law is ``key``: only doc_id and the topology decide.  slot numbers the rows
    of a shard from 0 without gaps.  grown_shard is the shard under ``more``
    (default: one more shard).

    Only doc_id, size and CRC are shuffled.  Equal rows are counted first and
    get consecutive slots, so a row that repeats very often is one row until the
    end.  Rows are ranked inside (shard, bucket) groups, so no task holds a shard;
    the offsets of the groups are at most shards * BUCKETS rows, which bounds what
    is broadcast.
    """
    leaves = leaves or topology()
    more = more or grown(leaves)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).select(
        "*",
        shard_of(F.col("doc_id"), leaves).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), more).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    different = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = different.withColumn("rank", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.expr("sequence(offset + rank, offset + rank + copies - 1)")).alias("slot"),
        "grown_shard",
    )
