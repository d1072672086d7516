"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.session import scratch_path, shared_folder, tune

#: A batch of texts handed to Python holds at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

#: Bits of the map that ``sieved`` sends to every task: 1 MB, whatever the size of the tables.
SIEVE_BITS = 1 << 23

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` stay (A-Z lowered first), all others become spaces.
ALNUM = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
              for c in range(256))
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive execution on, batches for Python bounded, a shared folder for stored stages."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, safe to recompute from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored stages of one run, each in a folder of its own, dropped once no later stage reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stored``; the frame carries its folder as ``scratch_folder``."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_folder = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the folders of stored frames that nothing reads any more."""
        context = self.spark.sparkContext
        for df in frames:
            path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieved(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted``: all that are, and few others; with ``left_anti`` the rest.

    To be joined exactly afterwards. Keys are hashed into a map of ``SIEVE_BITS`` bits, built by
    Spark and sent to every task, so that a join with a list of a few rows does not move all others.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1
    marks = wanted.select(place(wanted_key).alias("_place")).groupBy(
        F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return df.join(F.broadcast(marks), (F.bitmap_bucket_number(place(key)) == F.col("_bucket"))
                   & (F.getbit(byte, (at % 8).cast("int")) == 1), how)


def with_row(df: DataFrame) -> DataFrame:
    """Add ``_row``, unique per row even where ids are null or repeated.

    The number follows scan order, so store the result before it is joined to itself.
    """
    return df.withColumn("_row", F.monotonically_increasing_id())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def alnum_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words between the blanks U+0020 and U+0009 to U+000D, A-Z lowered."""
    return (text or "").encode().lower().split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64),
                           np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


_CACHE = {"up": _powers(_ROOT, 1 << 12), "down": _powers(_INVERSE, 1 << 12)}


def _table(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers; kept up to 2^20 of them, longer texts compute their own."""
    if len(_CACHE[kind]) < n:
        grown = _powers(_ROOT if kind == "up" else _INVERSE, 1 << (n - 1).bit_length())
        if len(grown) > 1 << 20:
            return grown[:n]
        _CACHE[kind] = grown
    return _CACHE[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words; equal runs have equal hashes.

    Polynomial hashes of the words joined by spaces, taken from one running sum, so the
    cost does not depend on ``k``.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1] + 1])
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _table("up", len(joined)), out=total[1:])
    first, last = starts[:n], ends[k - 1:k - 1 + n]
    span = (total[last] - total[first]) * _table("down", len(joined))[first]
    return mix(span + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rows_of(batches: Iterable, *names: str):
    """Python tuples of the named columns of Arrow batches, one batch at a time."""
    for batch in batches:
        yield zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])


def grouped(batches: Iterable, *names: str):
    """(key, rows) for each run of equal values in the first column of sorted batches."""
    rows = (row for batch in rows_of(batches, *names) for row in batch)
    return groupby(rows, key=lambda row: row[0])


def side_by_side(df: DataFrame, key: str) -> DataFrame:
    """Rows of equal keys together and next to each other, for ``grouped``."""
    return df.repartition(key).sortWithinPartitions(key)
