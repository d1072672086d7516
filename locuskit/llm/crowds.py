"""Links within crowds of similar sets, without comparing all their pairs.

A crowd is a group of sets that a tree of minwise values does not tell apart. Its core are the
values that more than half of its sets hold; what is stored of a set is D, its difference from
the core. For two sets x and y the difference is |Dx| + |Dy| - 2 |Dx and Dy|, so with
weight(x) = (den - num) |x| - (den + num) |Dx| they are linked, exactly, if

    weight(x) + weight(y) + 2 (den + num) |Dx and Dy| >= 0.

All sets that reach this with the heaviest one already for an empty intersection are linked to
it, a star in place of all pairs. Any other set x must share at least
need(x) = -(weight(x) + heaviest) / 2 (den + num) values of D with a partner. Only values that
several of the crowd's D hold count; a set with fewer than need has no link here. In one common
order, rarest first, two sets that share ``need`` of their values share one among the first
(number - need + 1): those name the set's sub-crowds. A sub-crowd of at most ``FEW`` sets is
compared in pairs; a larger one, at most half its parent since a shared value is not in the
core, is a crowd of the next round. No pair is skipped that could be linked, save those that
a star joins already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, rows_of

#: Sets of a sub-crowd whose pairs are compared one by one.
FEW = 64


def _counted(members: DataFrame) -> DataFrame:
    """(crowd, value, c): how many sets of the crowd hold a value, summed up batch by batch."""
    def run(batches):
        for batch in batches:
            at = {}
            for rows in rows_of([batch], "crowd", "values"):
                for crowd, values in rows:
                    at.setdefault(crowd, []).append(np.frombuffer(values, np.int64))
            for crowd, sets in at.items():
                value, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), crowd)), pa.array(value), pa.array(c)], names=["crowd", "value", "c"])
    parts = members.select("crowd", "values").mapInArrow(run, "crowd bigint, value bigint, c bigint")
    return parts.groupBy("crowd", "value").agg(F.sum("c").alias("c"))


def _differences(members: DataFrame, cores: DataFrame, num: int, den: int) -> DataFrame:
    """(crowd, cls, weight, d): each set's difference from its crowd's core."""
    def run(batches):
        for batch in batches:
            weights, ds = [], []
            core, ends = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            for i, values in enumerate(batch.column(2).to_pylist()):
                x = np.frombuffer(values, np.int64)
                d = np.setxor1d(x, core[ends[i]:ends[i + 1]], assume_unique=True)
                weights.append((den - num) * len(x) - (den + num) * len(d))
                ds.append(d)
            held = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(d) for d in ds])]).astype(np.int32),
                np.concatenate(ds) if ds else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weights, pa.int64()), held], names=["crowd", "cls", "weight", "d"])
    return members.join(cores, "crowd", "left").select("crowd", "cls", "values", "core").mapInArrow(
        run, "crowd bigint, cls binary, weight bigint, d array<bigint>")


def _need(weight, other, step: int):
    return F.ceil(-(weight + other) / F.lit(step)).cast("bigint")


def crowd_links(members: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b) that connect all linked classes of each crowd.

    ``members`` has (crowd bigint, cls), ``sets`` (cls, values): a class's distinct 64-bit
    values as bytes. Crowds may overlap; a class may be in many.
    """
    links, held, step = [], scratch.store(members.distinct(), "crowds"), 2 * (den + num)
    while not held.isEmpty():
        own = scratch.store(held.join(sets, "cls"), "crowd-sets")
        sizes = own.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
        cores = (_counted(own).join(sizes, "crowd").filter(2 * F.col("c") > F.col("n"))
                 .groupBy("crowd").agg(F.collect_list("value").alias("core")))  # below twice a set's size
        diff = scratch.store(_differences(own, cores, num, den), "differences")
        scratch.drop(own, held)
        heaviest = diff.groupBy("crowd").agg(F.max(F.struct("weight", "cls")).alias("top"))
        placed = diff.join(heaviest, "crowd")
        far = F.col("weight") + F.col("top.weight") < 0
        links.append(scratch.store(placed.filter(~far & (F.col("cls") != F.col("top.cls"))).select(
            F.col("cls").alias("a"), F.col("top.cls").alias("b")).distinct(), "stars"))
        outer = placed.filter(far).groupBy("crowd").agg(F.max("weight").alias("outer"))
        tokens = scratch.store(placed.join(outer, "crowd").select(
            "crowd", "cls", far.alias("far"), F.when(far, _need(F.col("weight"), F.col("top.weight"), step)).otherwise(
                F.greatest(F.lit(1).cast("bigint"), _need(F.col("weight"), F.col("outer"), step))).alias("need"),
            "weight", F.explode("d").alias("value")), "values")
        shared = tokens.groupBy("crowd", "value").agg(
            F.count(F.lit(1)).alias("df"), F.count_if("far").alias("n_far")).filter("df > 1 and n_far > 0").drop("n_far")
        each = Window.partitionBy("crowd", "cls")  # at most the size of one set's difference
        first = (tokens.join(shared, ["crowd", "value"])
                 .withColumn("place", F.row_number().over(each.orderBy("df", "value")))
                 .withColumn("have", F.count(F.lit(1)).over(each))
                 .filter("have >= need and place <= have - need + 1").select("crowd", "value", "cls", "far", "weight", "have"))
        first = scratch.store(first, "first")
        groups = scratch.store(first.groupBy("crowd", "value").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("far").alias("n_far")).filter("n > 1 and n_far > 0"), "sub-crowds")
        small = first.join(groups.filter(F.col("n") <= FEW).select("crowd", "value"), ["crowd", "value"])
        small = scratch.store(small, "few")
        pairs = small.filter("far").alias("x").join(small.alias("y"), ["crowd", "value"]).filter(
            (F.col("x.cls") < F.col("y.cls")) | (~F.col("y.far") & (F.col("x.cls") != F.col("y.cls"))))
        # values that both may share are bounded by those that either shares with any
        pairs = pairs.filter(F.col("x.weight") + F.col("y.weight") + step * F.least("x.have", "y.have") >= 0)
        pairs = pairs.select("crowd", F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        side = lambda name: diff.select(
            "crowd", F.col("cls").alias(name), F.col("weight").alias(f"w{name}"), F.col("d").alias(f"d{name}"))
        common = F.size(F.array_intersect("da", "db"))
        links.append(scratch.store(pairs.join(side("a"), ["crowd", "a"]).join(side("b"), ["crowd", "b"]).filter(
            F.col("wa") + F.col("wb") + step * common >= 0).select("a", "b").distinct(), "links"))
        large = groups.filter(F.col("n") > FEW).select("crowd", "value")
        held = scratch.store(first.join(large, ["crowd", "value"]).select(
            F.xxhash64("crowd", "value").alias("crowd"), "cls").distinct(), "crowds")
        scratch.drop(diff, tokens, first, groups, small)
    if not links:
        return scratch.store(members.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0), "links")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out
