"""Hierarchical weighted hash tree: documents descend from the region to the rack to the shard.

At each level every child of the reached node draws an exponential number with its weight as rate,
from a hash of the document's id and the child's path, and the smallest draw wins. A child is chosen in proportion
to its weight; if one weight grows, rows move to that child only, and if it shrinks, from that child only.

A shard that is added to an old rack raises the weights of its rack and region, and rows that come there would land on
the old shards as well. ``tree_of`` therefore gives each shard beyond the first ones a region of its own: then
one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import free_name, hash_unit, running_total


@dataclass(frozen=True)
class Leaf:
    """A shard (a number of its own) with its place and its weight above 0."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree_of(shards: int, first: int = 16, per_region: int = 8, per_rack: int = 4) -> list[Leaf]:
    """The tree for a number of shards: the first ones in full regions and racks, each later one a region by itself."""
    leaves = [Leaf(f"r{s // per_region}", f"k{s // per_rack}", s) for s in range(min(first, shards))]
    return leaves + [Leaf(f"own{s}", "k0", s) for s in range(first, shards)]


def _chosen(key: Column, path: str, children: dict[str, float], seed: str) -> Column:
    """Name of the child with the smallest weighted draw; equal draws go to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.log(hash_unit(seed, f"{path}/{c}", key)) / w).alias("draw"), F.lit(c).alias("name")) for c, w in sorted(children.items())]
    return F.least(*draws)["name"]


def _weights(leaves: list[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for leaf in leaves:
        out[name(leaf)] = out.get(name(leaf), 0.0) + leaf.weight
    return out


def _switch(on: Column, cases: dict[str, Column]) -> Column:
    names = list(cases)
    out = F.when(on == names[0], cases[names[0]])
    for n in names[1:]:
        out = out.when(on == n, cases[n])
    return out


def assigned(docs: DataFrame, tree: list[Leaf], id_col: str = "doc_id", into: str = "shard", seed: str = "shard") -> DataFrame:
    """Add ``into``: the shard that the id and the tree decide on. Null ids count as one id. A plain projection."""
    if len({leaf.shard for leaf in tree}) != len(tree) or not tree or any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("a tree needs leaves with shard numbers of their own and weights above 0")
    key, region, rack = F.col(id_col), free_name(docs, "region"), free_name(docs, "rack")
    regions: dict[str, list[Leaf]] = {}
    racks: dict[str, list[Leaf]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, []).append(leaf)
        racks.setdefault(f"{leaf.region}/{leaf.rack}", []).append(leaf)
    out = docs.withColumn(region, _chosen(key, "", _weights(tree, lambda x: x.region), seed))
    within = {r: _chosen(key, r, _weights(own, lambda x: f"{x.region}/{x.rack}"), seed) for r, own in regions.items()}
    out = out.withColumn(rack, _switch(F.col(region), within))
    below = {k: _chosen(key, k, _weights(own, lambda x: str(x.shard)), seed) for k, own in racks.items()}
    return out.withColumn(into, _switch(F.col(rack), below).cast("int")).drop(region, rack)


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: str = "shard", into: str = "slot") -> DataFrame:
    """Add ``into``: the place in the shard, gapless from 0, in the order of a hash of id and text.

    Places come from counts per shard and slice of the hash, so no task holds a shard. Rows with equal id and text
    are in any order among themselves.
    """
    draw, one = free_name(docs, "draw"), free_name(docs, "one")
    spread = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 12) / F.lit(float(2**52))
    return running_total(docs.withColumns({draw: spread, one: F.lit(1).cast("long")}), [shard], draw, [id_col], one, into).drop(draw, one)


def report(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", first: int = 16) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``law`` (``key``: the id and the number
    of shards decide), ``shard``, ``slot`` and ``grown_shard``, the shard when there is one more.

    The added shard is a region of its own at any number of shards: both trees have the same ``first`` shards, all of them
    if there are fewer. To grow on from fewer than 16 shards, name the number of shards at the beginning as ``first`` from then on.
    A null text has no bytes, repeated rows are one row each with slots of their own, null ids count as one id, and
    an empty table gives an empty result. Further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("__id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    first = min(first, shards)
    out = assigned(narrow, tree_of(shards, first), "__id", "shard")
    out = assigned(out, tree_of(shards + 1, first), "__id", "grown_shard")
    out = with_slots(out, "__id", "text_crc32")
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", first: int = 16) -> DataFrame:
    """The documents with all their columns and ``shard`` and ``slot``, ready to be written by shard; columns of these two names are replaced.

    ``first`` as in ``report``.
    """
    return with_slots(assigned(docs, tree_of(shards, first), id_col, "shard"), id_col, text_col)


def write_shards(docs: DataFrame, path: str, shard: str = "shard", slot: str = "slot", files_per_shard: int = 1) -> None:
    """Write a table that has shards and slots as one folder per shard; a large shard may have several files of equal slots."""
    part = F.pmod(F.col(slot), F.lit(files_per_shard))
    docs.repartition(F.col(shard), part).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
