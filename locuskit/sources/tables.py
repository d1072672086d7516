"""Parquet tables: write, read back, export, reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                existing: str = "overwrite_or_ignore", compression: str = "snappy",
                sort_by: Sequence[str] = (), most_rows: int = 0, stay: bool = False) -> None:
    """Write a plain or partitioned Parquet table.

    ``overwrite_or_ignore`` adds files beside those of other writes, ``delete_matching``
    replaces just the partitions that occur in ``df``, ``overwrite`` replaces all.

    A partitioned table is rebalanced by its partition columns first: a partition lies in one
    task, so in one file, unless its task is above the advisory size; a partition with a third
    of all rows is split into tasks of that size and has as many files. Rows that
    ``stay`` are written by the tasks they are in: no shuffle, and up to a file for each task and
    partition. ``sort_by`` orders the rows of a file, which lets readers skip row groups by their
    statistics. ``most_rows`` bounds the rows of a file.
    """
    if partition_by:
        df = (df if stay else df.hint("rebalance", *partition_by)).sortWithinPartitions(*partition_by, *sort_by)
    elif sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.option("compression", compression)
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if existing == "overwrite_or_ignore":
        writer.mode("append" if partition_by else "overwrite").parquet(path)
    elif existing == "delete_matching":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif existing == "overwrite":
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        raise ValueError(f"unknown mode {existing!r}")


def read_table(spark: SparkSession, path: str, flags: Sequence[str] = ()) -> DataFrame:
    """Read a table with its partition columns; ``flags`` are turned back into booleans."""
    df = spark.read.parquet(path)
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({f: F.col(f).cast("boolean") for f in flags if f in text})


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a completed Parquet write is at ``path``."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialize_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                          partition_by: Sequence[str] = ()) -> DataFrame:
    """The stored table if its write completed, else build, store and read it."""
    if not table_exists(spark, path):
        write_table(build(), path, partition_by, "overwrite")
    return read_table(spark, path)


def export_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True,
                     gzip: bool = False, most_rows: int = 0) -> None:
    """Text parts in a directory; one part per task, never one file through one task.

    ``most_rows`` bounds the rows of a part, as a reader takes a gzip file in one task.
    """
    writer = df.write.mode("overwrite").option("sep", sep).option("header", header)
    if gzip:
        writer = writer.option("compression", "gzip")
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    writer.csv(path)
