"""How far predictions cover measured regions, and which parts they miss.

Regions are (region_type, region, chrom, start_pos, end_pos) with inclusive ends;
predictions are (chrom, cre_start, cre_end, allele_pos).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import region_id
from locuskit.operators.intervals import bucketed_join
from locuskit.operators.ordered import with_group_values

REGION = ["region_type", "region", "chrom", "start_pos", "end_pos"]
STRETCH = 1 << 20


def region_coverage(regions: DataFrame, preds: DataFrame, widths: Sequence[int] | None = None,
                    hot_rows: int | None = None) -> DataFrame:
    """Covered stretch per (region, element); regions without any keep one NULL row.

    Predictions are collapsed to distinct positions before the join, and only regions
    with a match reach the aggregate; the left side is restored afterwards.
    """
    places = preds.select("chrom", "cre_start", "cre_end", "allele_pos").distinct()
    pairs = bucketed_join(regions.select(*REGION).distinct(), places, F.col("start_pos"),
                          F.col("end_pos"), F.col("allele_pos"), widths=widths,
                          hot_rows=hot_rows)
    found = (pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in REGION],
                           F.col("r.cre_start").alias("cre_start"),
                           F.col("r.cre_end").alias("cre_end"))
             .agg(F.min("r.allele_pos").alias("pred_start"),
                  F.max("r.allele_pos").alias("pred_end")))
    length = F.col("pred_end") - F.col("pred_start") + 1
    whole = F.col("end_pos") - F.col("start_pos") + 1
    return (regions.select(*REGION).distinct().join(found, REGION, "left")
            .select(*REGION, whole.alias("region_length"), "cre_start", "cre_end", "pred_start",
                    "pred_end", length.alias("pred_length"),
                    F.round(length * 100 / whole, 1).alias("region_cov")))


def matching_regions(coverage: DataFrame) -> DataFrame:
    """Number of elements, covered positions and summed percent per matched region."""
    return (coverage.filter(F.col("pred_length").isNotNull())
            .withColumn("region_id", region_id(F.col("chrom"), F.col("start_pos"), F.col("end_pos")))
            .groupBy("region_type", "region", "region_id", "region_length")
            .agg(F.count_distinct("cre_start").alias("total_cres"),
                 F.sum("pred_length").alias("total_pred_pos"),
                 F.round(F.sum("region_cov"), 3).alias("total_region_cov")))


def unmatched_regions(coverage: DataFrame) -> DataFrame:
    return (coverage.filter(F.col("pred_length").isNull())
            .select("region_type", "region",
                    region_id(F.col("chrom"), F.col("start_pos"), F.col("end_pos")).alias("region_id"),
                    "region_length"))


def _part(chrom: Column, start: Column, end: Column) -> list[Column]:
    """A half-open piece as (region_id, region_length)."""
    return [F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
            .alias("region_id"), (end - start).alias("region_length")]


def _outline(coverage: DataFrame) -> DataFrame:
    return (coverage.filter(F.col("pred_length").isNotNull()).groupBy(*REGION)
            .agg(F.min("pred_start").alias("first"), F.max("pred_end").alias("last")))


def _before() -> tuple[Column, Column, Column]:
    """(condition, start, end) of the part before the first covered position."""
    return F.col("first") > F.col("start_pos"), F.col("start_pos"), F.col("first")


def _after(compat: bool) -> tuple[Column, Column, Column]:
    start = F.col("last") if compat else F.col("last") + 1
    return F.col("last") < F.col("end_pos"), start, F.col("end_pos") + 1


def gap_before(coverage: DataFrame) -> DataFrame:
    """From region start to the first covered position."""
    some, start, end = _before()
    return (_outline(coverage).filter(some)
            .select("region_type", "region", *_part(F.col("chrom"), start, end)))


def gap_after(coverage: DataFrame, compat: bool = False) -> DataFrame:
    """From behind the last covered position to the region end.

    ``compat`` starts at the last covered position itself.
    """
    some, start, end = _after(compat)
    return (_outline(coverage).filter(some)
            .select("region_type", "region", *_part(F.col("chrom"), start, end)))


def _sweep(stretches: DataFrame, keys: Sequence[str], lo: Column | None = None,
           hi: Column | None = None) -> DataFrame:
    """(keys, a, b): the parts [a, b) that no stretch of the keys covers.

    ``stretches`` has (keys, pred_start, pred_end). One ordered pass over parts of ``STRETCH``
    positions gives the running reach and the next start within a part; the parts' own
    (first start, reach), one row each, are combined along the keys and supply what comes before
    a part. ``lo`` and ``hi``, first and last position of the keys, add the outer parts.
    Three shuffles, of which only the first moves the stretches.
    """
    part = [*keys, "_part"]
    placed = stretches.select(*keys, "pred_start", "pred_end", F.floor(F.col("pred_start") / STRETCH).alias("_part"))
    here, along = W.partitionBy(*part).orderBy("pred_start", "pred_end"), W.partitionBy(*keys).orderBy("_part")
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select(*part, F.lead("pred_start").over(here).alias("_near"),
                          F.max("pred_end").over(upto).alias("_reach"), F.min("pred_start").over(upto).alias("_first"))
    # the last row of a part knows all of it
    parts = local.filter(F.col("_near").isNull()).select(
        *part, "_reach", "_first", F.max("_reach").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.lead("_first").over(along).alias("_later"))
    behind = F.greatest("_reach", "_earlier") + 1
    inner = with_group_values(local.filter(F.col("_near") > F.col("_reach") + 1), parts, part, ["_earlier"]).select(
        *keys, behind.alias("a"), F.col("_near").alias("b"))
    none = F.lit(None).cast("bigint")
    edges = F.array(
        F.struct(F.coalesce(F.col("_earlier") + 1, none if lo is None else lo).alias("a"), F.col("_first").alias("b")),
        F.struct(behind.alias("a"), F.when(F.col("_later").isNull(), none if hi is None else hi + 1).alias("b")))
    outer = parts.select(*keys, F.explode(edges).alias("_e")).select(*keys, "_e.a", "_e.b")
    return inner.unionByName(outer).filter(F.col("b") > F.col("a"))


def gaps_between(coverage: DataFrame, compat: bool = False) -> DataFrame:
    """From behind a covered stretch to the start of the next one of the region.

    ``compat`` matches stretches by region name alone and keeps pieces of length <= 0.
    With it there is one row per pair of neighbouring stretches, so tied next starts repeat a
    row; without it one per gap, and what any earlier stretch covers is no gap.

    Equal stretches are collapsed first. The next start is looked up within parts of
    ``STRETCH`` positions of the chromosome, so no window grows with a region; the last
    start of a part continues at the first one of the next part that has any.
    """
    if not compat:
        found = _sweep(coverage.filter(F.col("pred_start").isNotNull()), ["region_type", "region", "chrom"])
        return found.select("region_type", "region", *_part(F.col("chrom"), F.col("a"), F.col("b")))
    keys = ["region"]
    part = [*keys, "_part"]
    # dealt by part once: collapsing, both windows, firsts and the join all find their rows together
    covered = (coverage.filter(F.col("pred_start").isNotNull())
               .select("region_type", "region", "chrom", "pred_start", "pred_end",
                       F.floor(F.col("pred_start") / STRETCH).alias("_part")).repartition(*part)
               .groupBy("region_type", "region", "chrom", "_part", "pred_start", "pred_end")
               .agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_copies", F.sum("_n").over(W.partitionBy(*part, "pred_start"))))
    spot = F.struct("pred_start", "_copies")
    # in descending order the rows before are those that start later
    later_here = W.partitionBy(*part).orderBy(F.desc("pred_start")).rangeBetween(W.unboundedPreceding, -1)
    firsts = covered.groupBy(*part).agg(F.min(spot).alias("_first"))
    following = firsts.select(*part, F.lead("_first").over(
        W.partitionBy(*keys).orderBy("_part")).alias("_later"))
    found = (covered.withColumn("_near", F.min(spot).over(later_here)).join(following, part)
             .withColumn("_next", F.coalesce("_near", "_later")).filter(F.col("_next").isNotNull()))
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("_n") * F.col("_next._copies"))
    return (found.withColumn("_copy", F.explode(copies))
            .select("region_type", "region",
                    *_part(F.col("chrom"), F.col("pred_end") + 1, F.col("_next.pred_start"))))


def missing_parts(coverage: DataFrame, compat: bool = False) -> DataFrame:
    """Every uncovered part of the partly covered regions.

    The parts before, between and behind come from one sweep. With ``compat`` the looser forms
    of the three are taken, each read from ``coverage`` again.
    """
    if compat:
        return gap_before(coverage).unionByName(gap_after(coverage, True)).unionByName(gaps_between(coverage, True))
    covered = coverage.filter(F.col("pred_length").isNotNull())
    gaps = _sweep(covered, REGION, F.col("start_pos"), F.col("end_pos"))
    return gaps.select("region_type", "region", *_part(F.col("chrom"), F.col("a"), F.col("b")))
