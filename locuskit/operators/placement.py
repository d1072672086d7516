"""Placing a sequence on another one of the same region, and moving positions along.

k-mers that occur once on either side are anchors (query position, target position). The
heaviest chain of anchors that rises in both is the placement; neighbours of a chain on one
diagonal form a gap-free block, and blocks grow over equal letters on both sides, so repeats
beside an anchor are placed too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import revcomp
from locuskit.operators.joins import skew_join
from locuskit.operators.sequences import windows


def rising_chain(targets: Sequence[int]) -> list[int]:
    """Indices of a longest rising run of ``targets``, the one of least ends.

    ``targets`` are in query order. Of all chains of one length the one that ends lowest is kept,
    with a link from each anchor to the end of the best chain before it.
    """
    ends, at, before = [], [], []
    for i, t in enumerate(targets):
        n = bisect_left(ends, t)
        before.append(at[n - 1] if n else -1)
        ends[n:n + 1], at[n:n + 1] = [t], [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def chained_blocks(query: str, target: str, anchors: Sequence[tuple[int, int]], k: int) -> list[list[int]]:
    """[t_start, t_end, q_start, q_end, anchors] of each gap-free block, in order."""
    blocks: list[list[int]] = []
    for i in rising_chain([t for _, t in anchors]):
        q, t = anchors[i]
        if blocks and blocks[-1][3] - blocks[-1][1] == q - t:
            blocks[-1][1], blocks[-1][3], blocks[-1][4] = t + k, q + k, blocks[-1][4] + 1
        else:
            blocks.append([t, t + k, q, q + k, 1])
    done: list[list[int]] = []
    for t0, t1, q0, q1, n in blocks:
        low_t, low_q = (done[-1][1], done[-1][3]) if done else (0, 0)
        cut = max(0, low_t - t0, low_q - q0)  # letters that the block before has taken
        if cut >= t1 - t0:
            continue
        t0, q0 = t0 + cut, q0 + cut
        while t0 > low_t and q0 > low_q and query[q0 - 1] == target[t0 - 1]:
            t0, q0 = t0 - 1, q0 - 1
        while t1 < len(target) and q1 < len(query) and query[q1] == target[t1]:
            t1, q1 = t1 + 1, q1 + 1
        done.append([t0, t1, q0, q1, n])
    return done


def place_by_kmers(query: DataFrame, target: DataFrame, k: int = 11, min_votes: int = 1,
                   key: str = "region", seq: str = "seq") -> DataFrame:
    """Strand and gap-free blocks of each query on the target of the same region.

    Both strands of the query are chained and the one of more anchors wins, forward on ties.
    Blocks rise along query and target and never overlap on either side: of letters that two
    neighbours could both take, the first one has them. A block between two gaps may hold
    unequal letters where both sides have as many. Blocks of fewer than ``min_votes`` anchors
    are left out. Blocks are half-open, numbered along the query as oriented. A region's two
    sequences and its anchors, at most one for each letter, are handled together.
    """
    both = query.select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("strand"), F.col(seq).alias("s")),
        F.struct(F.lit(-1).alias("strand"), revcomp(F.col(seq)).alias("s")))).alias("_q")).select(
        key, F.col("_q.strand").alias("strand"), F.col("_q.s").alias("s"))

    def singles(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
        return (windows(df, keys, column, k).groupBy(*keys, "window")
                .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias(name))
                .filter(F.col("n") == 1).drop("n"))

    found = singles(both, [key, "strand"], "s", "q").join(singles(target, [key], seq, "t"), [key, "window"])
    lists = found.groupBy(key, "strand").agg(F.sort_array(F.collect_list(F.struct("q", "t"))).alias("anchors"))
    rows = (both.join(lists, [key, "strand"])
            .join(target.select(key, F.col(seq).alias("_t")), key).select(key, "strand", "s", "_t", "anchors"))

    @F.pandas_udf("array<array<bigint>>")
    def blocks(s: pd.Series, t: pd.Series, anchors: pd.Series) -> pd.Series:
        pairs = lambda some: [(a["q"], a["t"]) for a in some]
        return pd.Series([chained_blocks(x, y, pairs(a), k) for x, y, a in zip(s, t, anchors)])

    placed = rows.select(key, "strand", blocks("s", "_t", "anchors").alias("_b"))
    votes = F.aggregate("_b", F.lit(0).cast("bigint"), lambda n, b: n + b[4])
    best = placed.groupBy(key).agg(F.max_by(F.struct("strand", "_b"), F.struct(votes, F.col("strand"))).alias("_w"))
    kept = F.filter(F.col("_w._b"), lambda b: b[4] >= min_votes)
    names = ["t_start", "t_end", "q_start", "q_end", "votes"]
    return (best.select(key, F.col("_w.strand").alias("strand"), F.posexplode(kept).alias("block", "_b"))
            .select(key, "strand", "block", *[F.col("_b")[i].alias(n) for i, n in enumerate(names)]))


def _oriented(rel: DataFrame, side: DataFrame, pos: str, ref: str, alt: str, key: str, more: Sequence[str]) -> DataFrame:
    """Positions and alleles as the placed strand reads them, with columns of ``side``."""
    lengths = rel.groupBy(key).agg((F.max(pos) + 1).alias("_len"))
    back = F.col("r.strand") == -1
    here = F.when(back, F.col("r._len") - 1 - F.col(f"l.{pos}")).otherwise(F.col(f"l.{pos}"))
    turned = {c: F.when(back, revcomp(F.col(f"l.{c}"))).otherwise(F.col(f"l.{c}")) for c in (ref, alt)}
    return skew_join(rel, side.join(lengths, key), [key]).select(
        *[turned.get(c, here if c == pos else F.col(f"l.{c}")).alias(c) for c in rel.columns],
        *[f"r.{c}" for c in more])


def positions_on_target(rel: DataFrame, blocks: DataFrame, pos: str = "rel_pos", ref: str = "ref_allele",
                        alt: str = "alt_allele", key: str = "region") -> DataFrame:
    """Positions in the coordinates of the target, for rows that lie in a block.

    On the reverse strand positions count from the other end and alleles are complemented.
    """
    side = blocks.groupBy(key).agg(F.max("strand").alias("strand"), F.collect_list(F.struct(
        "q_start", "q_end", "t_start")).alias("_blocks"))  # a region's blocks
    placed = _oriented(rel, side, pos, ref, alt, key, ["_blocks"])
    p = F.col(pos)
    inside = F.filter("_blocks", lambda b: (p >= b["q_start"]) & (p < b["q_end"]))
    moved = F.get(inside, F.lit(0))
    return (placed.withColumn("_m", moved).filter(F.col("_m").isNotNull())
            .select(*[(p - F.col("_m.q_start") + F.col("_m.t_start")).alias(c) if c == pos else F.col(c)
                      for c in rel.columns]))


def remap_positions(rel: DataFrame, blocks: DataFrame, pos: str = "rel_pos", ref: str = "ref_allele",
                    alt: str = "alt_allele", key: str = "region") -> DataFrame:
    """Positions relative to the first block, gaps of the query removed.

    On the reverse strand positions count from the other end and alleles are
    complemented; the effect stays with its row. Every gap shifts what follows by the sum
    of the gaps before it.
    """
    order = W.partitionBy(key).orderBy("block")
    side = (blocks.withColumn("_to", F.lead("q_start").over(order))
            .groupBy(key).agg(
                F.max("strand").alias("strand"), F.min("q_start").alias("_first"),
                F.collect_list(F.when(F.col("_to") > F.col("q_end"), F.struct(
                    F.col("q_end").alias("a"), F.col("_to").alias("b")))).alias("_gaps")))
    placed = _oriented(rel, side, pos, ref, alt, key, ["_gaps", "_first"])
    p = F.col(pos)
    shift = F.aggregate("_gaps", F.lit(0).cast("bigint"), lambda acc, g: acc + F.when(
        g["b"] <= p, g["b"] - g["a"]).otherwise(F.lit(0)))
    return (placed.filter(~F.exists("_gaps", lambda g: (p >= g["a"]) & (p < g["b"])))
            .select(*[(p - shift - F.col("_first")).alias(c) if c == pos else F.col(c)
                      for c in rel.columns]))
