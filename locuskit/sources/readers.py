"""Delimited experiment, prediction and motif files as lazy frames.

Schemas are explicit, or derived from the header line as text and cast by name, so that
no second pass guesses types.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskit.functions import (columns_matching, ln_to_log2, renamed_by_pattern, revcomp,
                                single_base, text_or_null)
from locuskit.operators.sampling import with_row_number
from locuskit.operators.variants import POSITION, count_averages, relative_to_reference
from locuskit.session import shuffle_partitions
from locuskit.sources.tables import write_table

# Header and file name patterns, and column names of the input files
BIN_RULES = [(r"^(?!input).*_rep", "output_rep"), (r"^.*_log2FC", "log2FC")]
SCAN_NAMES = {"sequence_name": "chrom", "p-value": "pvalue", "q-value": "qvalue"}
FASTA_HEADER = r"^>(\d+)\s+.*=(chr[0-9MXY]+):(\d+)-(\d+)"
SPAN = r"^([^:]+):(\d+)-(\d+)$"
EXPERIMENT = r"GRCh38_(.*).tsv$"
FIRST_PIECE = r"^([^-.]+)"
CELL_LINE = r"-([^-.]+).tsv$"
MIDDLE = r"-(.+)-"
PART_OF_FILE = r"(\.tsv)/[^/]+$"
SPDI_COLUMNS = {"chrom": "cre_chrom", "cre_start": "cre_start", "cre_end": "cre_end",
                "log2FC": "effect", "SPDI": "SPDI"}
SPDI_PARTS = ("allele_pos", "ref_allele", "allele")
MPRA_SCHEMA = ("Chromosome string, Position bigint, Ref string, Alt string, Tags bigint, "
               "DNA bigint, RNA bigint, Value double, `P-Value` double")
RELATIVE_SCHEMA = "rel_pos bigint, ref_allele string, alt_allele string, log2fc double"
CALLS_SCHEMA = "variantID string, theta double, lowerCI double, upperCI double, P_reg double"
SCAN_TYPES = {"start": "bigint", "stop": "bigint", "score": "double", "p-value": "double",
              "q-value": "double"}


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items() if c in df.columns})


def sorting_tasks(df: DataFrame) -> int:
    """Tasks among which the rows of ``df`` are sorted in memory: they follow the pieces it is read in.

    A gzip piece of 128 MB holds some ten million rows, and adaptive execution never makes more tasks than
    there are shuffle partitions. Up to 200 of them a shuffle holds no rows back on its writing side.
    """
    pieces = df.rdd.getNumPartitions()
    return max(shuffle_partitions(df), min(200, 8 * pieces), 2 * pieces)


def spread_compressed(df: DataFrame) -> DataFrame:
    """Rows of gzip files dealt to all tasks: such a file cannot be split, so one task reads it whole."""
    if not any(f.endswith(".gz") for f in df.inputFiles()):
        return df
    return df.repartition(shuffle_partitions(df))


def _header_text(spark: SparkSession, path: str | list[str], sep: str = "\t", **options) -> DataFrame:
    """All columns as text, named by the header; empty and ``NA`` cells are NULL."""
    fixed = {"header": True, "sep": sep, "inferSchema": False, "nullValue": "NA"}
    return spark.read.options(**(fixed | options)).csv(path)


def read_bins(spark: SparkSession, path: str, start_at: int = 0) -> DataFrame:
    """Assay bins with uniform replicate and effect names and the row number as ``index``."""
    raw = _header_text(spark, path)
    named = raw.select(*renamed_by_pattern(raw, BIN_RULES))
    types = {"start": "bigint", "end": "bigint", "log2FC": "double"}
    types |= {c: "bigint" for c in columns_matching(named, r"_rep")}
    return spread_compressed(with_row_number(_typed(named, types), start_at, by_file=True))


def read_motif_scan(spark: SparkSession, paths: str | list[str], q_cutoff: float = 0.1) -> DataFrame:
    """Motif matches up to a q-value from one or many scan files."""
    rows = _typed(_header_text(spark, paths), SCAN_TYPES)
    return spread_compressed(rows.filter(F.col("q-value") <= q_cutoff)).withColumnsRenamed(SCAN_NAMES)


def ingest_motif_scan(spark: SparkSession, paths: str | list[str], path: str,
                      q_cutoff: float = 0.1) -> None:
    """Store the matches partitioned by chromosome, beside those already there."""
    write_table(read_motif_scan(spark, paths, q_cutoff), path, ["chrom"])


def read_allele_preds_raw(spark: SparkSession, path: str | list[str],
                          conv: Callable[[Column], Column] | None = ln_to_log2,
                          effect: str = "log2FC", relative: str = "FC_to_ref") -> DataFrame:
    """Unprocessed predictions: element, bin, position, alleles, value, value relative to reference."""
    raw = (spark.read.option("sep", "\t")
           .schema("cre string, bin string, pos string, ref string, allele string, value double")
           .csv(path))
    part = lambda c, i: F.regexp_extract(c, SPAN, i)
    value = F.col("value") if conv is None else conv(F.col("value"))
    rows = raw.select(
        part("cre", 1).alias("cre_chrom"), part("cre", 2).cast("bigint").alias("cre_start"),
        part("cre", 3).cast("bigint").alias("cre_end"), part("bin", 1).alias("bin_chrom"),
        part("bin", 2).cast("bigint").alias("bin_start"), part("bin", 3).cast("bigint").alias("bin_end"),
        F.split_part("pos", F.lit("="), F.lit(2)).cast("bigint").alias("allele_pos"),
        F.split_part("ref", F.lit("="), F.lit(2)).alias("ref_allele"), "allele", value.alias(effect))
    tasks = sorting_tasks(raw)
    if tasks > shuffle_partitions(raw):
        rows = rows.repartition(tasks, *POSITION)
    return relative_to_reference(rows, effect, relative)


def read_allele_preds_spdi(spark: SparkSession, path: str | list[str], sep: str = "\t",
                           parts: Sequence[str] = SPDI_PARTS, **columns: str | None) -> DataFrame:
    """Processed predictions; the first component of the variant notation is dropped.

    Keyword arguments name input columns that differ from the usual ones; ``None`` keeps
    the usual one and an unknown keyword is an error.
    """
    unknown = set(columns) - set(SPDI_COLUMNS)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    names = SPDI_COLUMNS | {k: v for k, v in columns.items() if v is not None}
    raw = _header_text(spark, path, sep)
    piece = F.split(F.col(f"`{names['SPDI']}`"), ":")
    col = lambda k: F.col(f"`{names[k]}`")
    return raw.select(
        col("chrom").alias("chrom"), col("cre_start").cast("bigint").alias("cre_start"),
        col("cre_end").cast("bigint").alias("cre_end"), col("log2FC").cast("double").alias("log2FC"),
        piece[1].cast("bigint").alias(parts[0]), piece[2].alias(parts[1]), piece[3].alias(parts[2]))


def ingest_allele_preds(spark: SparkSession, source: str | list[str], path: str, sep: str = "\t",
                        form: str = "processed", compression: str = "lz4_raw",
                        partition_by: str | None = "chrom", **columns: str | None) -> None:
    """Store predictions as a Parquet table, replacing an older one.

    Any ``form`` but "processed" reads raw files: reference rows are dropped, no logarithm
    is converted and ``log2FC`` is the effect relative to reference. All rows are written by the tasks
    that read or compared them, sorted by chromosome, and do not travel again.
    """
    if form == "processed":
        preds = read_allele_preds_spdi(spark, source, sep, **columns)
    else:
        preds = (read_allele_preds_raw(spark, source, None, "effect", "log2FC")
                 .filter(F.col("allele") != F.col("ref_allele"))
                 .withColumnRenamed("cre_chrom", "chrom"))
    write_table(preds, path, [partition_by] if partition_by else [], "overwrite", compression, stay=True)


def _from_path() -> dict[str, Column]:
    """Path and parent folder; a "file" may itself be a folder of parts."""
    path = F.regexp_replace("_metadata.file_path", PART_OF_FILE, "$1")
    return {"file_path": path, "region_type": F.element_at(F.split(path, "/"), -2)}


def read_mpra(spark: SparkSession, folder: str, single_base_only: bool = True) -> DataFrame:
    """Measured variants of ``<folder>/<region type>/*.tsv``; rows with any NULL are dropped.

    Without ``single_base_only`` deletions stay and only the five columns that describe
    where something was measured are returned.
    """
    raw = (spark.read.options(header=True, sep="\t", nullValue="NA").schema(MPRA_SCHEMA)
           .csv(f"{folder}/*/*.tsv"))
    rows = spread_compressed(raw.withColumns(_from_path()))
    if single_base_only:
        rows = rows.filter(single_base(F.col("Ref"), F.col("Alt")))
    named = rows.select(
        F.concat(F.lit("chr"), "Chromosome").alias("chrom"), (F.col("Position") - 1).alias("allele_pos"),
        F.col("Ref").alias("ref_allele"), F.col("Alt").alias("alt_allele"), "Tags", "DNA", "RNA",
        "Value", F.col("P-Value").alias("p_value"), "file_path",
        text_or_null(F.col("file_path"), EXPERIMENT).alias("experiment"), "region_type")
    named = named.withColumn("region", text_or_null(F.col("experiment"), FIRST_PIECE))
    if not single_base_only:
        named = named.select("chrom", "allele_pos", "experiment", "region", "region_type")
    return named.dropna("any")


def read_relative_preds(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by position within a region, of ``<folder>/<region type>/*.tsv``."""
    raw = spark.read.options(sep="\t", nullValue="NA").schema(RELATIVE_SCHEMA).csv(f"{folder}/*/*.tsv")
    rows = raw.withColumns(_from_path())
    name = F.element_at(F.split("file_path", "/"), -1)
    return (rows.select(
        (F.col("rel_pos") - 1).alias("rel_pos"), "ref_allele", "alt_allele", "log2fc", "file_path",
        "region_type", text_or_null(name, FIRST_PIECE).alias("region"),
        text_or_null(name, CELL_LINE).alias("cell_line"),
        text_or_null(name, MIDDLE).alias("experiment")).dropna("any"))


def read_fasta_bins(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(index, chrom, start, end) of every header line; a malformed header is an error."""
    heads = spark.read.text(path).filter(F.col("value").startswith(">"))
    ok = F.when(F.col("value").rlike(FASTA_HEADER), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("malformed header: "), "value")))
    part = lambda i: F.regexp_extract("value", FASTA_HEADER, i)
    return heads.withColumn("value", ok).select(
        part(1).cast("bigint").alias("index"), part(2).alias("chrom"),
        part(3).cast("bigint").alias("start"), part(4).cast("bigint").alias("end"))


def split_variant_id(df: DataFrame, variant_id: str = "variantID") -> DataFrame:
    """``chrom:pos:ref:alt`` with a 1-based position as four columns, single-base rows only."""
    piece = F.split(variant_id, ":")
    rest = [c for c in df.columns if c != variant_id]
    named = df.select(piece[0].alias("chrom"), (piece[1].cast("bigint") - 1).alias("allele_pos"),
                      piece[2].alias("ref_allele"), piece[3].alias("alt_allele"), *rest)
    one = lambda c: F.octet_length(c) == 1
    return named.filter(one("ref_allele") & one("alt_allele"))


def read_bayes_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Posterior effect sizes per variant."""
    return split_variant_id(spark.read.option("sep", "\t").schema(CALLS_SCHEMA).csv(path))


def _one_number(lo: int | None, hi: int | None, what: str) -> int:
    if lo is None or lo != hi:
        raise ValueError(f"expected one number of {what}, got {lo} to {hi}")
    return lo


def read_bayes_counts(spark: SparkSession, path: str | list[str], averages: bool = True) -> DataFrame:
    """Replicate counts; the number of columns follows the replicate numbers in the file.

    Both numbers must be the same in all rows (one aggregate, run here).
    """
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    number = lambda i: F.nullif(F.get("c", i), F.lit("NA")).cast("bigint")
    inputs = number(F.lit(1))
    found = cells.select(inputs.alias("i"), number((2 + 2 * inputs).cast("int")).alias("o")).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("i", "o") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    n_in = _one_number(found["lo_i"], found["hi_i"], "inputs")
    n_out = _one_number(found["lo_o"], found["hi_o"], "outputs")
    names = (["n_inputs"] + [f"input{i}_{a}" for i in range(1, n_in + 1) for a in ("ref", "alt")]
             + ["n_outputs"] + [f"output{i}_{a}" for i in range(1, n_out + 1) for a in ("ref", "alt")])
    rows = split_variant_id(cells.select(F.get("c", F.lit(0)).alias("variantID"),
                                         *[number(F.lit(i + 1)).alias(c) for i, c in enumerate(names)]))
    if not averages:
        return rows
    groups = {f"{side}_{a}": columns_matching(rows, f"^{side}[0-9]+_{a}$")
              for side in ("input", "output") for a in ("ref", "alt")}
    return count_averages(rows, groups)


def read_kmer_weights(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(kmer, weight) with each k-mer's upper-case reverse complement; the later line wins.

    Of several files the one later by path wins. ``path`` may be a list or a pattern.
    """
    lines = spread_compressed(with_row_number(spark.read.text(path).filter(F.trim("value") != ""), name="line", by_file=True))
    cells = F.split(F.trim("value"), r"\s+")
    parsed = lines.select("line", cells[0].alias("kmer"), cells[1].cast("double").alias("weight"))
    both = parsed.select("weight", F.explode(F.array(
        F.struct((F.col("line") * 2).alias("rank"), F.col("kmer").alias("kmer")),
        F.struct((F.col("line") * 2 + 1).alias("rank"), revcomp(F.upper("kmer")).alias("kmer")))
    ).alias("s"))
    return both.groupBy("s.kmer").agg(F.max_by("weight", "s.rank").alias("weight"))


def read_cv_preds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Held-out predictions by row id."""
    return _typed(_header_text(spark, path, ","), {"index": "bigint", "true": "double",
                                                   "predicted": "double"})


def read_schema(spark: SparkSession, path: str | list[str], schema: str | T.StructType,
                sep: str = "\t", header: bool = True) -> DataFrame:
    """Any other delimited file with a known schema, ``NA`` as NULL."""
    return spark.read.options(sep=sep, header=header, nullValue="NA").schema(schema).csv(path)
