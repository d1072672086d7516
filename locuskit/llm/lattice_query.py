"""op3: all documents scored by the subword lattice."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.lattice import score_texts
from locuskit.llm.registry import query

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@query("op3_subword_lattice")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
