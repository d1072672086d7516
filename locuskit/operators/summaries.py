"""Region tables, counts, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.operators.ordered import exact_quantiles, same_keys, value_counts, with_group_values


def name_list(column: str, separator: str = ",") -> Column:
    """Names in order, as text; rows are distinct in ``column`` within their group."""
    return F.array_join(F.sort_array(F.collect_list(column)), separator)


def mpra_regions(mpra: DataFrame) -> DataFrame:
    """Extent (inclusive ends), length and experiments of each measured region."""
    keys = ["region_type", "region", "chrom"]
    per_experiment = mpra.groupBy(*keys, "experiment").agg(F.min("allele_pos").alias("lo"),
                                                           F.max("allele_pos").alias("hi"))
    start, end = F.min("lo"), F.max("hi")
    return (per_experiment.groupBy(*keys)
            .agg(start.alias("start_pos"), end.alias("end_pos"),
                 (end - start + 1).alias("region_length"),
                 name_list("experiment").alias("experiments")))


def provenance_summary(df: DataFrame, key: str, other: str) -> DataFrame:
    """Per ``key``: how many distinct values of ``other``, and which."""
    return (df.select(key, other).distinct().groupBy(key)
            .agg(F.count(other).alias("num_values"), name_list(other).alias("names")))


def class_counts(df: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Row counts at several grouping levels at once; absent columns are NULL."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return df.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("rows"))


def table_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and the share of keys with more than one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"),
                       F.count_if(F.col("n") > 1).alias("repeated_keys"),
                       F.try_divide(F.count_if(F.col("n") > 1), F.count(F.lit(1)))
                       .alias("repeated_share"))


def matched_share(matched: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows and their share of the distinct keys of ``universe``."""
    total = universe.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return matched.agg(F.count(F.lit(1)).alias("matched")).select(
        "matched", total.alias("universe"),
        F.try_divide(F.col("matched"), total).alias("share"))


def strong_elements(preds: DataFrame, threshold: float = 0.2, effect: str = "FC_to_ref") -> DataFrame:
    """Elements with any relative effect above the threshold."""
    return preds.filter(F.col(effect) > threshold).select("cre_chrom", "cre_start").distinct()


def histogram(df: DataFrame, value: str, bins: int = 50, by: str | None = None,
              density: bool = False) -> DataFrame:
    """Equal-width histogram over the shared range of all series, empty bins included.

    The last bin is closed. A single distinct value gets a range of width one around it.
    NULL and NaN values are left out; a NULL series is a series.
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    span = known.agg(F.struct(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("s"))
    flat = F.col("s.lo") == F.col("s.hi")
    edges = span.select(F.struct((F.col("s.lo") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
                                 (F.col("s.hi") + F.when(flat, 0.5).otherwise(0.0)).alias("hi"))).scalar()
    series = F.col(by) if by else F.lit("all")
    lo, hi = edges["lo"], edges["hi"]
    slot = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = (known.select(series.alias("series"), slot.cast("int").alias("bin"))
              .groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n")))
    full = (counts.groupBy("series").agg(F.sum("n").alias("total"))
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    width = (hi - lo) / bins
    n = F.coalesce(F.col("n"), F.lit(0))
    height = F.try_divide(n, F.col("total") * width) if density else n.cast("double")
    found = full.alias("f").join(counts.alias("c"), same_keys("f", "c", ["series", "bin"]), "left")
    return (found.select("f.series", "f.bin", "total", "n")
            .select("series", "bin", (lo + width * F.col("bin")).alias("bin_lo"),
                    (lo + width * (F.col("bin") + 1)).alias("bin_hi"), n.alias("n"),
                    height.alias("height")))


NOTCH = 1.57


def _box(df: DataFrame, group: Sequence[str], value: str,
         whis: float | tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """Distinct (group, value) counts, and quartiles with whisker limits per group."""
    counts = value_counts(df, group, value)
    cuts = {"q1": (0.25, "cont"), "med": (0.5, "cont"), "q3": (0.75, "cont")}
    if isinstance(whis, tuple):
        cuts |= {"lo_limit": (whis[0] / 100, "cont"), "hi_limit": (whis[1] / 100, "cont")}
    box = exact_quantiles(counts, group, value, cuts).withColumn("iqr", F.col("q3") - F.col("q1"))
    if not isinstance(whis, tuple):
        box = (box.withColumn("lo_limit", F.col("q1") - whis * F.col("iqr"))
               .withColumn("hi_limit", F.col("q3") + whis * F.col("iqr")))
    return counts, box


def box_stats(df: DataFrame, group: Sequence[str], value: str,
              whis: float | tuple[float, float] = 1.5) -> DataFrame:
    """Quartiles, whiskers, notch and number of outliers per group.

    ``whis`` is a multiple of the interquartile range, or a pair of percentiles.
    """
    counts, box = _box(df, group, value, whis)
    v, n, lo, hi = F.col(value), F.col("n"), F.col("lo_limit"), F.col("hi_limit")
    names = ["total", "q1", "med", "q3", "iqr"]
    reach = (with_group_values(counts, box, group, [*names, "lo_limit", "hi_limit"])
             .groupBy(*group, *names)
             .agg(F.min(F.when(v >= lo, v)).alias("_lo"),
                  F.max(F.when(v <= hi, v)).alias("_hi"),
                  F.sum(F.when((v < lo) | (v > hi), n)
                        .otherwise(F.lit(0))).alias("outliers")))
    notch = NOTCH * F.col("iqr") / F.sqrt(F.col("total"))
    return reach.select(
        *group, F.col("total").alias("n"), "q1", "med", "q3",
        F.least("q1", F.coalesce("_lo", "q1")).alias("whisker_lo"),
        F.greatest("q3", F.coalesce("_hi", "q3")).alias("whisker_hi"),
        (F.col("med") - notch).alias("notch_lo"), (F.col("med") + notch).alias("notch_hi"),
        "outliers")


def box_outliers(df: DataFrame, group: Sequence[str], value: str,
                 whis: float | tuple[float, float] = 1.5) -> DataFrame:
    """Distinct values beyond the whiskers, with their number of rows."""
    counts, box = _box(df, group, value, whis)
    beyond = (F.col(value) < F.col("lo_limit")) | (F.col(value) > F.col("hi_limit"))
    return (with_group_values(counts, box, group, ["lo_limit", "hi_limit"])
            .filter(beyond).select(*group, value, "n"))
