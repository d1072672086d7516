"""Joins of genomic intervals with positions, by an equi-join on nested bins.

Every join here has the form "a position of one side lies between two positions of the
other". The chromosome is cut into bins at several levels, each sixteen times as wide as the one
below. An interval belongs to the lowest level whose bins are at least a sixteenth of its length,
so it touches at most 17 of them; a position lies in one bin of each level. The two meet by
hash on (chromosome, bin); the full predicate then decides. No pair is produced twice, as an
interval has one level and a position one bin in it. Positions look only into levels that some
interval uses, so a table of short intervals costs one lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.functions import motif_name
from locuskit.operators.joins import skew_join

MOST_BUCKETS = 16
#: 256 bases to 268 megabases; a longer interval is cut into more than 17 of the widest bins.
LEVELS = tuple(256 * MOST_BUCKETS ** i for i in range(6))


def _bucket(position: Column, size: Column) -> Column:
    return position - F.pmod(position, size)


def _level(length: Column, widths: Sequence[int]) -> Column:
    """The smallest width of which at most sixteen make up the length; the last one if none."""
    size = F.lit(widths[-1]).cast("bigint")
    for smaller in reversed(widths[:-1]):
        size = F.when(length <= smaller * MOST_BUCKETS, F.lit(smaller).cast("bigint")).otherwise(size)
    return size


def interval_bins(intervals: DataFrame, lo: Column, hi: Column, widths: Sequence[int] = LEVELS) -> DataFrame:
    """Add ``_lo``, ``_hi``, ``_size`` and ``_bucket``: a row for each bin that an interval touches."""
    spans = (intervals.select("*", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
             .filter(F.col("_lo") <= F.col("_hi"))
             .select("*", _level(F.col("_hi") - F.col("_lo"), sorted(widths)).alias("_size")))
    return spans.select("*", F.explode(F.sequence(_bucket(F.col("_lo"), F.col("_size")), F.col("_hi"), F.col("_size")))
                        .alias("_bucket"))


def position_bins(points: DataFrame, at: Column, widths: Sequence[int] = LEVELS, used: Column | None = None) -> DataFrame:
    """Add ``_at``, ``_size`` and ``_bucket``: a row for each level, of the ``used`` ones if given."""
    sizes = F.array(*[F.lit(w).cast("bigint") for w in sorted(widths)])
    if used is not None:
        sizes = F.array_intersect(sizes, used)
    places = points.select("*", at.cast("bigint").alias("_at")).filter(F.col("_at").isNotNull())
    return (places.select("*", F.explode(sizes).alias("_size"))
            .select("*", _bucket(F.col("_at"), F.col("_size")).alias("_bucket")))


def bucketed_join(intervals: DataFrame, points: DataFrame, lo: Column, hi: Column, at: Column,
                  residual: Column | None = None, keys: Sequence[str] = ("chrom",),
                  widths: Sequence[int] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Pairs with equal ``keys`` and lo <= at <= hi; sides are aliased ``l`` and ``r``.

    ``lo`` and ``hi`` are integer expressions over ``intervals``, ``at`` over ``points``;
    ``residual`` uses the aliases. Without ``widths`` the levels are ``LEVELS`` and an aggregate
    over the intervals' lengths tells which of them occur; given widths are all looked up.
    """
    levels, used = widths or LEVELS, None
    if widths is None:
        length = hi.cast("bigint") - lo.cast("bigint")
        used = intervals.filter(length >= 0).agg(F.collect_set(_level(length, sorted(levels)))).scalar()  # at most six
    left, right = interval_bins(intervals, lo, hi, levels), position_bins(points, at, levels, used)
    inside = (F.col("r._at") >= F.col("l._lo")) & (F.col("r._at") <= F.col("l._hi"))
    return skew_join(left, right, [*keys, "_bucket", "_size"], inside if residual is None else inside & residual, hot_rows)


def _named(features: DataFrame) -> DataFrame:
    """The columns joins need; names are cut out here, once per feature, not once per pair."""
    return features.select("chrom", "start", "stop", "motif_id", "motif_alt_id",
                           motif_name(F.col("motif_alt_id")).alias("motif_name"))


def contained_join(bins: DataFrame, features: DataFrame, carry: Sequence[str] = ("log2FC",),
                   widths: Sequence[int] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Features that lie fully inside a bin, with the bin's ``carry`` columns."""
    slim_bins = bins.select("chrom", "start", "end", *carry)
    slim = _named(features)
    pairs = bucketed_join(slim_bins, slim, F.col("start"), F.col("end"), F.col("start"),
                          F.col("l.end") >= F.col("r.stop"), widths=widths,
                          hot_rows=hot_rows)
    return pairs.select(
        F.col("l.chrom").alias("chrom"), F.col("l.start").alias("seq_start"),
        F.col("l.end").alias("seq_end"), F.col("r.motif_id").alias("motif_id"),
        F.col("r.motif_alt_id").alias("motif_alt_id"),
        F.col("r.motif_name").alias("motif_name"),
        F.col("r.start").alias("mot_start"), F.col("r.stop").alias("mot_stop"),
        *[F.col(f"l.{c}").alias(c) for c in carry])


def within_distance_join(features: DataFrame, k: int = 1000, widths: Sequence[int] | None = None,
                         hot_rows: int | None = None) -> DataFrame:
    """Ordered feature pairs: the second starts after the first stops and ends within k."""
    slim = _named(features).drop("motif_alt_id")
    pairs = bucketed_join(slim, slim, F.col("stop") + 1, F.col("start") + k, F.col("start"),
                          F.col("l.start") + k >= F.col("r.stop"), widths=widths or (max(LEVELS[0], k // 4),),
                          hot_rows=hot_rows)
    return pairs.select(
        F.col("l.chrom").alias("chrom"), F.col("l.start").alias("start"),
        (F.col("l.stop") - F.col("l.start")).alias("motif_length"),
        F.col("l.motif_id").alias("motif_id"),
        F.col("l.motif_name").alias("motif_name"),
        F.col("r.motif_id").alias("motif2_id"),
        F.col("r.motif_name").alias("motif2_name"),
        (F.col("r.start") - F.col("l.start")).alias("motif_distance"))


def padded_point_join(features: DataFrame, preds: DataFrame, pad: int = 5, widths: Sequence[int] | None = None,
                      hot_rows: int | None = None) -> DataFrame:
    """Predictions whose position is in a feature widened by ``pad`` on both sides."""
    slim = _named(features)
    points = preds.select("chrom", "allele_pos", "ref_allele", "allele", "log2FC")
    pairs = bucketed_join(slim, points, F.col("start") - pad, F.col("stop") + pad,
                          F.col("allele_pos"), widths=widths, hot_rows=hot_rows)
    return pairs.select(
        F.col("l.motif_id").alias("motif_id"), F.col("l.motif_alt_id").alias("motif_alt_id"),
        F.col("l.motif_name").alias("motif_name"),
        F.col("l.chrom").alias("chrom"), F.col("l.start").alias("mot_start"),
        F.col("l.stop").alias("mot_end"), F.col("r.allele_pos").alias("allele_pos"),
        F.col("r.ref_allele").alias("ref_allele"), F.col("r.allele").alias("alt_allele"),
        F.col("r.log2FC").alias("log2FC"))


def in_interval(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows fully inside one interval."""
    return df.filter((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("end") <= end))
