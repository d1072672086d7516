"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the
shared folder and rereads as the next stage's documents. All but the last keep the columns
of documents. Columns other than doc_id and text travel in one struct, so their names
cannot clash with those an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm import quality as rules
from locuskit.llm.common import prepare, read_table, sieved, stored
from locuskit.llm.decontaminate import contamination
from locuskit.llm.near_dedup import near_duplicates
from locuskit.llm.packing import pack
from locuskit.llm.packing_query import TOKENIZER
from locuskit.llm.pii import masked, personal_data

CARRIED = "pipeline_row"


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias(CARRIED))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(CARRIED)[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1; null and empty texts fail it."""
    return _restored(rules.ledger(_carried(docs)).filter(rules.passes("v1")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id.

    Rows that share an id stay or go together; of those with equal texts too, one stays.
    Rows without an id stay, one for each text.
    """
    found = stored(near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near_dedup")
    gone = found.filter(~F.col("kept")).select("doc_id")
    again = found.filter("n > 1").select(F.col("doc_id").alias("pipeline_id"))
    # documents of no listed id stay where they are: only the others are joined, with all their columns
    listed, ids = found.filter("not kept or n > 1"), F.col("doc_id")
    rest, some = (sieved(docs, ids, listed, ids, how) for how in ("left_anti", "left_semi"))
    left, same = some.join(gone, "doc_id", "left_anti"), F.col("doc_id").eqNullSafe(F.col("pipeline_id"))
    out = left.join(again, same, "left_anti").unionByName(
        left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).unionByName(rest)
    return out.select(*[f"`{c}`" for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    rows = contamination(_carried(docs).withColumn("pipeline_text", F.col("text")), items, keep=("pipeline_text", CARRIED))
    return _restored(rows.filter(~F.col("contaminated")).withColumnRenamed("pipeline_text", "text"), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text."""
    rows = personal_data(_carried(docs), keep=("text", CARRIED))
    out = _restored(rows.withColumn("text", masked(F.col("text"), F.col("pii_spans"))), docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 ids."""
    return pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii),
          ("packing", packing)]
#: Contexts learnt in rounds and tokenizer ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
