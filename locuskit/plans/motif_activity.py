"""Motif matches on assay bins: stored hits, active motifs, combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.operators import motifs as mo
from locuskit.operators.intervals import contained_join
from locuskit.operators.joins import skew_join, tagged_union
from locuskit.operators.stats import p_cutoff_for_q
from locuskit.sources.tables import materialize_if_absent, read_table, write_table


def store_significant(spark: SparkSession, matches_path: str, path: str, q: float = 0.05) -> float:
    """Keep the matches below the p-value that belongs to ``q``; returns that p-value."""
    matches = read_table(spark, matches_path)
    cutoff = p_cutoff_for_q(matches, q)
    write_table(mo.significant(matches, cutoff), path, ["chrom"], "overwrite")
    return cutoff


def stored_hits(spark: SparkSession, bins: DataFrame, matches: DataFrame, path: str,
                carry: Sequence[str] = ("log2FC", "train", "test")) -> DataFrame:
    """Motif hits in bins, computed once and kept at ``path``."""
    return materialize_if_absent(spark, path, lambda: contained_join(bins, matches, carry), ["chrom"])


def active_hits(hits: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Hits of the motifs whose median activation reaches the threshold."""
    stats = mo.hit_stats(hits)
    active = stats.filter(F.col("median_log2FC") >= threshold).select("motif_id").distinct()
    return skew_join(hits, active, ["motif_id"]).select(*[F.col(f"l.{c}") for c in hits.columns])


def compared_datasets(hits: dict[str, DataFrame], threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """For several bin sets: median per motif and dataset, and the motifs active in any."""
    stats = mo.dedup_median(tagged_union(hits, "dataset"), ["dataset"])
    return stats, mo.active_set(stats, "motif_name", threshold)


def active_combinations(combos: dict[str, DataFrame], threshold: float = 0.1, min_bins: int = 9,
                        max_motifs: int = 3) -> DataFrame:
    """Bins of the motif combinations that are active in any dataset."""
    tagged = tagged_union(combos, "dataset")
    chosen = mo.active_set(mo.combination_stats(tagged, ["dataset"]), "motif_names", threshold,
                           min_bins, max_motifs=max_motifs)
    named = tagged.drop("motif_names").withColumnRenamed("motif_names_o", "motif_names")
    return named.join(chosen.select("motif_names"), "motif_names", "left_semi")
