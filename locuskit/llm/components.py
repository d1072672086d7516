"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch


def _contract(edges: DataFrame, large: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends point at the smallest of a node's neighbourhood, the stored minima).

    The large step moves greater neighbours of every node, the small step the node and its
    lesser neighbours. Only minima are aggregated: no neighbourhood is collected, and a hub
    is an equi-join key that adaptive execution splits.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = scratch.store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is its component's least node.

    Each round is stored in the shared folder and the one before it dropped. Nodes may be of any
    ordered type; null ends and links of a node to itself are ignored.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter("a is not null and b is not null and a <> b").distinct())
    edges, last = scratch.store(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            break
        last, before = mark, edges
        moved, wide = _contract(edges, True, scratch)
        moved = scratch.store(moved, "edges")
        edges, narrow = _contract(moved, False, scratch)
        edges = scratch.store(edges, "edges")
        scratch.drop(before, wide, moved, narrow)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
