"""op13: SimHash near-duplicates among all documents (XXH64 has no SQL; brute force in the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.registry import query
from locuskit.llm.simhash import as_hex, simhash_duplicates


@query("op13_deletion_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", as_hex(rows["print"]).alias("fingerprint"), "component_id")
