"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends from the root level by level, regions, racks, shards: each child of the node it has reached
draws an exponential variate from a hash of the key and the child's place, at the rate of the weight of its
subtree, and the least draw takes the row. So a level costs as many hashes as the node has children,
whatever lies below. A changed weight changes the draws of the subtrees that hold it alone: rows move only
into these (or, where it shrinks, only out of them).

A shard that is added to a rack would draw rows into its whole region, whose racks then share them. `grow`
therefore adds a shard as a region of its own: no other subtree's weight changes, and rows move only into
the new shard, which is the law `key`.

DataFrame functions only. Rows with a null key hash alike and share a shard; a null or empty text has
size 8 and the checksum 0; repeated rows stay and get slots of their own; an empty table gives an
empty result; of further columns only those named are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered apart; a window holds one part.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 3, racks: int = 2) -> list[Leaf]:
    """Shards 0 to shards-1 dealt in turn over the racks."""
    return [Leaf(s % regions, s // regions % racks, s) for s in range(shards)]


def grow(tree: Sequence[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, which rows move only into."""
    return [*tree, Leaf(max(leaf.region for leaf in tree) + 1, 0, shard, weight)]


def _drawn(key: Column, level: str, node: Column) -> Column:
    """A child's draw."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node["place"]), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**53))) / node["weight"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard to which a key descends."""
    leaves = [leaf for leaf in tree if leaf.weight > 0]
    if not leaves or len({leaf.shard for leaf in leaves}) < len(leaves):
        raise ValueError("a tree needs shards of positive weight, each once")
    grouped: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        grouped.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)

    def node(place: str, under: Sequence[Leaf], **more: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(float(sum(x.weight for x in under))).alias("weight"), *[c.alias(n) for n, c in more.items()])

    def shards(rack: Sequence[Leaf]) -> Column:
        return F.array(*[node(str(x.shard), [x], shard=F.lit(x.shard)) for x in rack])

    def racks(region: int) -> Column:
        return F.array(*[node(f"{region}/{n}", rack, shards=shards(rack)) for n, rack in grouped[region].items()])

    root = F.array(*[node(str(n), [x for rack in region.values() for x in rack], racks=racks(n)) for n, region in grouped.items()])

    def least(children: Column, level: str, then: str) -> Column:
        """What the child with the least draw holds."""
        drawn = F.transform(children, lambda c: F.struct(_drawn(key, level, c).alias("draw"), c["place"].alias("place"), c[then].alias(then)))
        first = lambda a, b: F.when((b["draw"] < a["draw"]) | (b["draw"] == a["draw"]) & (b["place"] < a["place"]), b).otherwise(a)
        return F.aggregate(F.slice(drawn, 2, F.size(drawn)), F.get(drawn, 0), first)[then]

    def let(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), 0)

    in_region = let(root, lambda c: least(c, "region", "racks"))
    in_rack = let(in_region, lambda c: least(c, "rack", "shards"))
    return let(in_rack, lambda c: least(c, "shard", "shard"))


def numbered(df: DataFrame, shard: str, order: Sequence[str], parts: int = SLOT_PARTS) -> DataFrame:
    """df with `slot`, gapless from 0 in each shard.

    Each shard is numbered in parts by a hash of the ordering columns, and the parts' sizes are summed
    up, so that no task gets a whole shard.
    """
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(parts)).cast("int"))
    local = cut.withColumn("_at", F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order)) - 1)
    sizes = cut.groupBy(shard, "_part").agg(F.count("*").alias("_size"))
    upto = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"))
    return local.join(starts, [shard, "_part"]).withColumn("slot", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", tree: Sequence[Leaf] | None = None, grown: Sequence[Leaf] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    tree = tree or even_tree(shards)
    grown = grown or grow(tree, shards)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    )
    return numbered(rows, "shard", [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
