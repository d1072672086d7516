"""op8: all documents packed into sequences of 2048 ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.packing import pack
from locuskit.llm.registry import query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op8_histogram_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
