"""Motif scans stored file by file, each file once.

Scans come as one file per chromosome and are added to one partitioned table. A file
stream with a checkpoint does that incrementally: files seen before are skipped, and a
lost executor or driver neither loses nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from locuskit.session import shared_folder
from locuskit.sources.readers import SCAN_NAMES, SCAN_TYPES


def ingest_new_scans(spark: SparkSession, folder: str, path: str, columns: list[str],
                     q_cutoff: float = 0.1, name: str = "motif-scans") -> StreamingQuery:
    """Add the matches of all files not seen yet, then stop; ``columns`` is the files' header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.readStream.schema(schema).options(header=True, sep="\t").csv(folder)
    typed = raw.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in SCAN_TYPES.items() if c in columns})
    kept = typed.filter(F.col("q-value") <= q_cutoff).withColumnsRenamed(SCAN_NAMES)
    return (kept.writeStream.format("parquet").partitionBy("chrom").outputMode("append")
            .option("path", path)
            .option("checkpointLocation", f"{shared_folder(spark)}/{name}")
            .trigger(availableNow=True).start())
