"""Summaries of motif matches, motif hits in bins, pairs and combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.functions import motif_name
from locuskit.operators.joins import skew_join
from locuskit.operators.ordered import exact_quantiles, value_counts, with_group_values

MOTIF = ["motif_id", "motif_alt_id", "motif_name"]
MEDIAN = (0.5, "cont")


def significant(matches: DataFrame, p: float) -> DataFrame:
    return matches.filter(F.col("pvalue") < p)


def is_true(flag: Column) -> Column:
    """Split flags are booleans, or the text 'true' when read back as partition values."""
    return F.lower(flag.cast("string")) == "true"


def grouped_stats(df: DataFrame, keys: Sequence[str], value: str,
                  quantiles: dict[str, tuple[float, str]], count: str,
                  **sums: Column) -> DataFrame:
    """Row count, sums and exact quantiles per key from one collapse to (keys, value).

    Rows whose value is NULL count towards ``count`` and the sums, not the quantiles.
    """
    counts = (df.groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias(count), *[F.sum(k).alias(k) for k in sums])
    cuts = exact_quantiles(counts.filter(F.col(value).isNotNull()), keys, value, quantiles)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return (totals.alias("a").join(cuts.alias("b"), on, "left")
            .select(*[F.col(f"a.{c}") for c in totals.columns],
                    *[F.col(f"b.{q}") for q in quantiles]))


def motif_match_counts(matches: DataFrame) -> DataFrame:
    return (matches.groupBy("motif_id", "motif_alt_id").agg(F.count(F.lit(1)).alias("num_matches"))
            .select("motif_id", motif_name(F.col("motif_alt_id")).alias("motif_name"), "num_matches")
            .orderBy(F.desc("num_matches")))


def pair_stats(pairs: DataFrame, min_pairs: int = 2) -> DataFrame:
    """Distance summary per ordered pair of motifs that occurs at least ``min_pairs`` times."""
    keys = ["motif_id", "motif_name", "motif2_name"]
    counts = value_counts(pairs, keys, "motif_distance")
    d, n = F.col("motif_distance"), F.col("n")
    plain = (counts.groupBy(*keys)
             .agg(F.sum(n).alias("numpairs"), F.min(d).alias("min_distance"),
                  F.max(d).alias("max_distance"),
                  F.round(F.sum(d * n) / F.sum(n), 1).alias("avg_distance"))
             .filter(F.col("numpairs") >= min_pairs))
    medians = exact_quantiles(counts, keys, "motif_distance", {"median_distance": MEDIAN})
    return with_group_values(plain, medians, keys, ["median_distance"])


def hit_stats(hits: DataFrame, keys: Sequence[str] = MOTIF, value: str = "log2FC") -> DataFrame:
    """Hits, train and test hits, median and member quantiles of activation per motif."""
    return grouped_stats(hits, list(keys), value,
                         {f"median_{value}": MEDIAN, f"q75_{value}": (0.75, "disc"),
                          f"q95_{value}": (0.95, "disc")}, "num_hits",
                         train_hits=is_true(F.col("train")).cast("int"),
                         test_hits=is_true(F.col("test")).cast("int"))


def combination_hits(hits: DataFrame, carry: Sequence[str] = ("log2FC",),
                     flags: Sequence[str] = ("train", "test")) -> DataFrame:
    """Bins with several motif hits, the last starting behind the end of some other.

    Copies of a hit are collapsed first: what is left of a bin is at most one row per
    position and motif, a bound set by bin length and motif library.
    """
    bin_key = ["chrom", "seq_start", "seq_end"]
    slim = (hits.groupBy(*bin_key, "mot_start", "motif_id", "motif_name")
            .agg(F.count(F.lit(1)).alias("n"), F.min("mot_stop").alias("stop"),
                 *[F.min(c).alias(c) for c in carry],
                 *[F.max(is_true(F.col(f))).alias(f) for f in flags]))
    item = F.collect_list(F.struct("mot_start", "motif_id", "motif_name", F.col("n").cast("int").alias("n")))
    names = F.flatten(F.transform(F.sort_array("_items"),
                                  lambda x: F.array_repeat(x["motif_name"], x["n"])))
    grouped = (slim.groupBy(*bin_key)
               .agg(F.sum("n").alias("num_hits"), F.max("mot_start").alias("_last"),
                    F.min("mot_start").alias("_first"), F.min("stop").alias("_stop"), item.alias("_items"),
                    *[F.min(c).alias(c) for c in carry], *[F.max(f).alias(f) for f in flags])
               .filter((F.col("num_hits") > 1) & (F.col("_last") > F.col("_stop"))))
    motifs = F.size(F.array_distinct(F.col("_items.motif_id"))).cast("bigint")
    return grouped.withColumn("_names", names).select(
        *bin_key, "num_hits", motifs.alias("num_tfs"),
        (F.col("_last") - F.col("_first")).alias("max_motif_dist"),
        F.array_join("_names", ", ").alias("motif_names"),
        F.array_join(F.sort_array("_names"), ", ").alias("motif_names_o"), *carry, *flags)


def combination_stats(combos: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Activation summary per lexically ordered combination, and per ``by`` columns."""
    keys = [*by, "motif_names"]
    named = combos.drop("motif_names").withColumnRenamed("motif_names_o", "motif_names")
    stats = grouped_stats(named, keys, "log2FC",
                          {"median_log2FC": MEDIAN, "q75_log2FC": (0.75, "disc"),
                           "q95_log2FC": (0.95, "disc")}, "num_seqs",
                          train_seqs=F.col("train").cast("int"), test_seqs=F.col("test").cast("int"))
    sizes = named.groupBy(*keys).agg(F.min("num_hits").alias("num_motifs"),
                                     F.min("num_tfs").alias("num_tfs"))
    return with_group_values(stats, sizes, keys, ["num_motifs", "num_tfs"])


def combination_distance_stats(combos: DataFrame, more_than: int = 300) -> DataFrame:
    """Bins, train and test bins and median activation per (combination, distance)."""
    keys = ["motif_names", "max_motif_dist"]
    return grouped_stats(combos, keys, "log2FC", {"median_log2FC": MEDIAN}, "num_seqs",
                         in_train=F.col("train").cast("int"), in_test=F.col("test").cast("int")
                         ).filter(F.col("num_seqs") > more_than)


def active_set(stats: DataFrame, key: str, threshold: float, min_count: int = 0,
               count: str = "num_seqs", max_motifs: int | None = None) -> DataFrame:
    """Names whose median reaches ``threshold`` in some dataset, with the largest median."""
    kept = stats.filter(F.col("median_log2FC") >= threshold)
    if min_count:
        kept = kept.filter(F.col(count) >= min_count)
    if max_motifs is not None:
        kept = kept.filter(F.col("num_motifs") <= max_motifs)
    return (kept.groupBy(key).agg(F.max("median_log2FC").alias("median_log2FC"))
            .orderBy("median_log2FC", key))


def dedup_median(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median activation per motif over distinct (bin, activation) rows."""
    keys = [*by, "motif_name"]
    rows = hits.select(*keys, "chrom", "seq_start", "log2FC").distinct()
    return (exact_quantiles(value_counts(rows, keys, "log2FC"), keys, "log2FC",
                            {"median_log2FC": MEDIAN}).drop("total"))


def motif_mutation_stats(mut_hits: DataFrame) -> DataFrame:
    """Per motif id: chromosomes, hits, rows and extremes of the predicted effect.

    Rows are collapsed to matches first, so the distinct counts see few rows per motif.
    """
    matches = (mut_hits.groupBy("motif_id", "chrom", "mot_start")
               .agg(F.min("motif_name").alias("motif_name"), F.count(F.lit(1)).alias("n"),
                    F.min("log2FC").alias("lo"), F.max("log2FC").alias("hi")))
    return (matches.groupBy("motif_id")
            .agg(F.min("motif_name").alias("motif_name"),
                 F.count_distinct("chrom").alias("num_chroms"),
                 F.count_distinct("mot_start").alias("num_motif_hits"), F.sum("n").alias("num_mut"),
                 F.min("lo").alias("min_log2FC"), F.max("hi").alias("max_log2FC"))
            .withColumn("max_abs_log2FC", F.greatest(F.abs("min_log2FC"), F.abs("max_log2FC"))))


def ambiguous_motif_names(mut_hits: DataFrame) -> DataFrame:
    """Motif names that stand for several ids, with the inclusive and plain match lengths."""
    return (mut_hits.groupBy("motif_name", "motif_id")
            .agg(F.min(F.col("mot_end") - F.col("mot_start")).alias("lo"),
                 F.max(F.col("mot_end") - F.col("mot_start")).alias("hi"))
            .groupBy("motif_name")
            .agg(F.array_join(F.sort_array(F.collect_set("motif_id")), ",").alias("motif_ids"),
                 F.count(F.lit(1)).alias("num_ids"),
                 (F.min("lo") + 1).alias("motif_len_min"), (F.max("hi") + 1).alias("motif_len_max"))
            .filter(F.col("num_ids") > 1))


def position_effects(mut_hits: DataFrame, min_effect: float = 0.5, min_hits: int = 9) -> DataFrame:
    """Largest effect at each position of each match of the motifs worth showing."""
    stats = motif_mutation_stats(mut_hits)
    shown = (stats.filter((F.col("max_abs_log2FC") >= min_effect)
                          & (F.col("num_motif_hits") >= min_hits)).select("motif_id"))
    keys = ["motif_id", "motif_name", "chrom", "mot_start", "mot_end", "allele_pos", "ref_allele"]
    largest = F.max_by(F.struct("alt_allele", "log2FC"),
                       F.struct(F.abs("log2FC").alias("a"), F.col("alt_allele").alias("b"),
                                F.col("log2FC").alias("c")))
    best = mut_hits.groupBy(*keys).agg(largest.alias("_best"))
    return (skew_join(best, shown, ["motif_id"])
            .select("l.motif_id", "l.motif_name", "l.chrom", "l.mot_start", "l.mot_end",
                    (F.col("l.allele_pos") - F.col("l.mot_start")).alias("motif_pos"),
                    "l.ref_allele", "l._best.alt_allele", "l._best.log2FC"))


def distance_bins(df: DataFrame, width: int = 10, distance: str = "max_motif_dist",
                  whole: bool = False) -> DataFrame:
    """Add ``dist_category``, the middle of the distance bin; ``whole`` truncates it."""
    middle = F.floor(F.col(distance) / width) * width + F.lit(width / 2.0)
    return df.withColumn("dist_category", middle.cast("bigint") if whole else middle.cast("double"))
