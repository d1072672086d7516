"""Which parts of measured regions still need predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.operators import coverage as co
from locuskit.operators.summaries import mpra_regions
from locuskit.sources.tables import export_delimited, materialize_if_absent


def region_descriptors(spark: SparkSession, mpra: DataFrame, preds: DataFrame, folder: str,
                       compat: bool = False) -> dict[str, DataFrame]:
    """Coverage is stored once below ``folder``; every list of parts reads it.

    Each list is also written as (region_id, region_length) text without a header.
    """
    coverage = materialize_if_absent(
        spark, f"{folder}/coverage", lambda: co.region_coverage(mpra_regions(mpra), preds))
    lists = {"not_matching": co.unmatched_regions(coverage),
             "matching_full": co.matching_regions(coverage),
             "pre": co.gap_before(coverage), "post": co.gap_after(coverage, compat),
             "inter": co.gaps_between(coverage, compat),
             "all_missing": co.missing_parts(coverage, compat)}
    for name, rows in lists.items():
        export_delimited(rows.select("region_id", "region_length"), f"{folder}/{name}", header=False)
    return lists
