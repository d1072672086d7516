"""op5: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.common import read_table
from locuskit.llm.pii import BASE, personal_data
from locuskit.llm.registry import query


@query("op5_bootstrapped_contexts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE) & s["seed"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
