"""Equi-joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.session import shuffle_partitions

def _hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys above a fair share of either side, with the number of cuts for each side.

    A fair share is 1/partitions of a side, so at most 2 x partitions keys qualify
    whatever the data size: that is the bound which lets the result be broadcast.
    """
    parts = shuffle_partitions(left)
    keys = [F.col(k) for k in on]
    both = (left.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(right.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    counts = both.groupBy(*on).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = counts.agg(F.struct(F.sum("_a").alias("a"), F.sum("_b").alias("b"))).scalar()

    def cuts(side: str) -> Column:
        share = F.greatest(F.lit(float(hot_rows)), total[side[1:]] / F.lit(parts))
        return F.ceil(F.col(side) / share).cast("int")

    return (counts.select(*on, F.greatest(cuts("_a"), F.lit(1)).alias("_cuts_a"),
                          F.greatest(cuts("_b"), F.lit(1)).alias("_cuts_b"))
            .filter((F.col("_cuts_a") > 1) | (F.col("_cuts_b") > 1)))


def _salted(side: DataFrame, hot: DataFrame, on: Sequence[str], own: str, other: str) -> DataFrame:
    """Own rows fall into one cut by content hash and meet every cut of the other side."""
    cut = (F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]),
                  F.coalesce(F.col(f"_cuts_{own}"), F.lit(1)))).cast("int")
    names = side.columns
    marked = side.join(F.broadcast(hot), list(on), "left")
    return marked.select(
        *[F.col(f"`{c}`") for c in names], cut.alias(f"_s{own}"),
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_cuts_{other}"), F.lit(1)) - 1))
        .alias(f"_s{other}"))


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str],
              condition: Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """Inner join on the shared columns ``on``; sides are aliased ``l`` and ``r``.

    By default hot keys are left to adaptive execution, which splits oversized partitions
    of either side when it sees their real sizes (``session.tune`` makes it do so even at
    the price of another shuffle). With ``hot_rows`` the keys above that many rows and
    above a fair share are counted first, in a narrow map-side combined pass, and both
    sides are cut at them by content hash.
    """
    keys = list(on)
    if hot_rows is None:
        a, b = left.alias("l"), right.alias("r")
    else:
        hot = _hot_keys(left, right, on, hot_rows)
        a = _salted(left, hot, on, "a", "b").alias("l")
        b = _salted(right, hot, on, "b", "a").alias("r")
        keys += ["_sa", "_sb"]
    match = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    return a.join(b, match if condition is None else match & condition)


def partitioned_join(left: DataFrame, right: DataFrame, partition_col: str, condition: Column | None,
                     select: Sequence[Column], hot_rows: int | None = None,
                     between: tuple[Column, Column, Column] | None = None, piece_rows: int = 10_000) -> DataFrame:
    """Theta join within equal values of ``partition_col`` (sides ``l`` and ``r``).

    One declarative join in place of a loop over partition values. ``between`` is a range
    condition (lo, hi, at): bounds over the left side, a number over the right one, with
    lo <= at <= hi; the join is then cut along the data (see
    :func:`locuskit.operators.band.range_join`). For intervals and positions on chromosomes
    :func:`locuskit.operators.intervals.bucketed_join` does it with one shuffle.
    A right side without the partition column is joined by the condition alone, which
    must then hold an equality for Spark to hash on, or by ``between``.
    """
    if between is not None:
        from locuskit.operators.band import range_join
        lo, hi, at = between
        keys = [partition_col] if partition_col in right.columns else []
        kept = left.filter(F.col(partition_col).isNotNull())
        return range_join(kept, right, lo, hi, at, keys, condition, piece_rows).select(*select)
    if partition_col in right.columns:
        return skew_join(left, right, [partition_col], condition, hot_rows).select(*select)
    return (left.filter(F.col(partition_col).isNotNull()).alias("l")
            .join(right.alias("r"), condition).select(*select))


def infill(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All primary rows, then the secondary rows whose key primary does not have."""
    known = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(known, list(keys), "left_anti"))


def join_by_index(preds: DataFrame, bins: DataFrame, index: str = "index") -> DataFrame:
    """Coordinates and predictions by row id, in genome order."""
    return (preds.join(bins.select(index, "chrom", "start", "end"), index)
            .select("chrom", "start", "end", *[c for c in preds.columns if c != index])
            .orderBy("chrom", "start"))


def semi_by_list(df: DataFrame, columns: Sequence[str], wanted: DataFrame, key: str) -> DataFrame:
    """Rows in which any of ``columns`` is among ``wanted[key]``; no row is repeated."""
    hits = [F.col(f"_in{i}") for i, _ in enumerate(columns)]
    out = df
    for i, column in enumerate(columns):
        mark = (wanted.select(F.col(key).alias(column)).distinct()
                .withColumn(f"_in{i}", F.lit(True)))
        out = out.join(mark, column, "left")
    return out.filter(F.coalesce(*hits)).select(*df.columns)


def add_split_flags(bins: DataFrame, splits: dict[str, DataFrame], index: str = "index",
                    check: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """One boolean column per split; a listed bin that is absent or lies elsewhere is an error."""
    out = bins
    for name, ids in splits.items():
        listed = ids.select(F.col(index).alias("_id"), *[F.col(c).alias(f"_{c}") for c in check])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in check])
        absent = (listed.join(bins.select(F.col(index).alias("_id")), "_id", "left_anti")
                  .agg(F.min("_id").cast("string").alias("id")).scalar())
        flag = (F.when(absent.isNotNull(), F.raise_error(F.concat(
                    F.lit(f"no bin for split {name}: "), absent)).cast("boolean"))
                .when(F.col("_id").isNull(), False).when(same, True)
                .otherwise(F.raise_error(F.concat(F.lit(f"index mismatch with split {name}: "),
                                                  F.col("_id").cast("string"))).cast("boolean")))
        out = (out.join(listed.distinct(), F.col(index) == F.col("_id"), "left")
               .select(*out.columns, flag.alias(name)))
    return out


def split_sizes(bins: DataFrame, splits: Sequence[str]) -> DataFrame:
    """(split, size, fraction) for each boolean column."""
    total = F.count(F.lit(1))
    sums = bins.agg(total.alias("total"), *[F.count_if(F.col(s)).alias(s) for s in splits])
    return (sums.select("total", F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(s).alias("size")) for s in splits])).alias("s"))
        .select("s.split", "s.size", F.try_divide(F.col("s.size"), F.col("total")).alias("fraction")))


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of frames by name with the dictionary key as a leading column."""
    parts = [df.select(F.lit(k).alias(tag), *df.columns) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
