"""op7: the visible text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.common import read_table
from locuskit.llm.registry import query
from locuskit.llm.rendering import rendered


@query("op7_layout_rendering")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", F.col("rendered_text").alias("text"))
