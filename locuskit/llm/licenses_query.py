"""op2: licenses in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.common import read_table
from locuskit.llm.licenses import license_scan
from locuskit.llm.registry import query


@query("op2_signature_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("license_base", lambda b: b["start"])
    base = F.transform("license_base", lambda b: b["label"])
    more = F.transform("license_spans", lambda s: s["label"])
    joined = lambda labels: F.concat_ws(",", F.sort_array(F.array_distinct(labels)))
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size("license_base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.col("license_score").alias("score"))
