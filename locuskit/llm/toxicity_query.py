"""op6: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.registry import query
from locuskit.llm.toxicity import toxicity


@query("op6_compression_distance")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                    read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
