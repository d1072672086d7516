"""Intervals and positions stored by their bins, so that joining them moves no row.

Both tables are bucketed by chromosome, bin and level (see ``operators/intervals``) into the same
number of buckets, one sorted file each. A join of two such tables reads bucket with bucket,
and a table that is joined again and again is shuffled once, when it is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.operators.intervals import LEVELS, interval_bins, position_bins

BIN = ["_bucket", "_size"]


def _store(binned: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    columns = [*keys, *BIN]
    dealt = binned.repartition(buckets, *columns)  # the bucket's own hash, so each task has one bucket
    (dealt.write.format("parquet").mode("overwrite").option("path", path)
     .bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(name))
    return binned.sparkSession.table(name)


def store_intervals(df: DataFrame, name: str, path: str, lo: Column, hi: Column, keys: Sequence[str] = ("chrom",),
                    buckets: int = 64) -> DataFrame:
    """Intervals with inclusive ends as table ``name`` below ``path``, a row for each bin they touch."""
    return _store(interval_bins(df, lo, hi), name, path, keys, buckets)


def store_positions(df: DataFrame, name: str, path: str, at: Column, keys: Sequence[str] = ("chrom",),
                    buckets: int = 64, widths: Sequence[int] = LEVELS) -> DataFrame:
    """Positions as table ``name`` below ``path``, a row for each of the levels ``widths``."""
    return _store(position_bins(df, at, widths), name, path, keys, buckets)


def stored_join(intervals: DataFrame, positions: DataFrame, residual: Column | None = None,
                keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Pairs of two stored tables (sides ``l`` and ``r``) whose position lies in the interval."""
    match = (F.col("r._at") >= F.col("l._lo")) & (F.col("r._at") <= F.col("l._hi"))
    for c in [*keys, *BIN]:
        match = match & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    # merged bucket by bucket, whatever the sizes: a broadcast would move one side
    return intervals.alias("l").join(positions.alias("r").hint("merge"), match if residual is None else match & residual)


def drop_stored(spark: SparkSession, *names: str) -> None:
    """Forget tables; their files stay at their paths."""
    for name in names:
        spark.sql(f"drop table if exists `{name}`")
