"""Hierarchical weighted hash tree: region, rack, shard.

A document descends the tree. At each node every child draws ``-ln(u) / weight`` with ``u``
from a hash of the document's key and the child's path, and the smallest draw wins. A
child's draws depend on nothing but the key, its path and its own weight, so changing one
weight moves documents only into or out of that child; siblings exchange none, and the
movement goes no higher than the node whose weight changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.llm.common import prepare, stored


@dataclass(frozen=True)
class Node:
    """``children`` or a ``shard`` number; ``weight`` is what the parent weighs it by."""

    path: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None

    def nodes(self):
        yield self
        for c in self.children:
            yield from c.nodes()

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=-1)

    def reweighted(self, path: str, weight: float) -> Node:
        """The tree with one node's weight changed; the weights above it stay."""
        return replace(self, weight=weight if self.path == path else self.weight,
                       children=tuple(c.reweighted(path, weight) for c in self.children))


def build(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Node:
    """A tree over shards 0 to ``shards`` - 1; a node weighs as much as it has shards."""
    size = racks_per_region * shards_per_rack
    regions = []
    for r, first in enumerate(range(0, shards, size)):
        held, racks = range(first, min(first + size, shards)), []
        for k, at in enumerate(range(held.start, held.stop, shards_per_rack)):
            leaves = tuple(Node(f"r{r}/k{k}/s{s}", 1.0, shard=s)
                           for s in range(at, min(at + shards_per_rack, held.stop)))
            racks.append(Node(f"r{r}/k{k}", float(len(leaves)), leaves))
        regions.append(Node(f"r{r}", float(len(held)), tuple(racks)))
    return Node("", float(shards), tuple(regions))


def grown(tree: Node) -> Node:
    """One shard more, in a region of its own: it takes documents only into itself.

    Inside an old region it would raise that region's weight, and some documents drawn to
    the region would come to its old shards.
    """
    shard = 1 + max(n.shard for n in tree.nodes() if n.shard is not None)
    region = f"r{len(tree.children)}"
    leaf = Node(f"{region}/k0/s{shard}", 1.0, shard=shard)
    return replace(tree, weight=tree.weight + 1, children=(
        *tree.children, Node(region, 1.0, (Node(f"{region}/k0", 1.0, (leaf,)),))))


def draw(key: Column, path: Column, weight: Column) -> Column:
    unit = (F.conv(F.substring(F.md5(F.concat_ws("|", key, path)), 1, 13), 16, 10).cast("double")
            + 0.5) / float(1 << 52)
    return -F.log(unit) / weight


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key (string, not null) as int. A weight must be above 0."""
    inner = [n for n in tree.nodes() if n.children]
    below = F.create_map(*[x for n in inner for x in (F.lit(n.path), F.array(*[
        F.struct(F.lit(c.path).alias("path"), F.lit(c.weight).alias("weight")) for c in n.children]))])
    leaves = F.create_map(*[x for n in tree.nodes() if n.shard is not None
                            for x in (F.lit(n.path), F.lit(n.shard))])
    path = F.lit(tree.path)
    for _ in range(tree.depth):
        children = F.try_element_at(below, path)
        best = F.array_min(F.transform(children, lambda c: F.struct(
            draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path"))))
        path = F.coalesce(best["path"], path)
    return F.element_at(leaves, path)


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def shard_rows(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text",
               next_tree: Node | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    The key alone decides the shard; equal keys meet, and all null keys share one. Slots
    number a shard's rows from 0 without gaps: rows are ordered within pieces named by a
    hash of key and text, and the small table of piece counts gives each piece its start, so
    no task holds a shard. Only numbers are shuffled, never texts. Rows equal in key and
    text are interchangeable and may share a piece.
    """
    prepare(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = key_text(F.col(key))
    tagged = docs.select(
        F.col(key), (F.octet_length(whole) + 1).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"), shard_of(name, tree).alias("shard"),
        (shard_of(name, next_tree) if next_tree else F.lit(None).cast("int")).alias("grown_shard"))
    tagged = stored(tagged.withColumn("_piece", F.substring(F.md5(F.concat_ws(
        "|", F.lit("slot"), name, F.col("text_crc32"))), 1, 3)), "shards")
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (tagged.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
              .select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    order = W.partitionBy("shard", "_piece").orderBy(key, "size", "text_crc32")
    ranked = tagged.withColumn("_rank", F.row_number().over(order) - 1)
    return ranked.join(starts, ["shard", "_piece"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot"), "grown_shard")
