"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` consecutive hashes of ``gram`` words the smallest is kept as a
fingerprint (the last of equal ones). Two texts that share ``window`` words share the whole
group of hashes, hence its fingerprint: no such span can be missed. Fingerprints of
documents and items are joined, and each hit is extended along its diagonal over the very
words, so hash collisions cannot add a hit. An item of fewer words than ``window`` is one
window; its only fingerprint is the hash of all its words, looked up among the documents'
hashes of that length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import alnum_words, gram_hashes, prepare, stored

GRAM, WINDOW = 5, 10
#: Up to so many item fingerprints (8 bytes each) are sent to every task to sieve the documents'
#: fingerprints before they are shuffled; with more, all fingerprints go to the join.
SIEVE = 2_000_000


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the last smallest hash of every ``width`` neighbours; sorted, distinct."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    groups = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    spots = np.arange(len(groups)) + width - 1 - groups.argmin(axis=1)
    return np.unique(spots)


def fingerprints(words: list[bytes], gram: int, window: int, short: tuple[int, ...],
                 known: np.ndarray | None) -> tuple[list[int], list[int]]:
    """Hashes and word positions; only those in ``known`` unless it is None."""
    hashes, spots = [], []
    full = gram_hashes(words, gram)
    at = winnow(full, window - gram + 1)
    for h, p in [(full[at], at)] + [(g := gram_hashes(words, n) ^ np.uint64(n), np.arange(len(g))) for n in short]:
        if known is not None and len(h):
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            keep = known[i] == h if len(known) else np.zeros(len(h), bool)
            h, p = h[keep], p[keep]
        hashes += h.view(np.int64).tolist()
        spots += p.tolist()
    return hashes, spots


def item_classes(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, norm): items with words; null texts have none. Equal word runs have equal ``norm``."""
    def normal(batches):
        for batch in batches:
            norms = [b" ".join(alnum_words(t)) for t in batch.column(1).to_pylist()]
            keep = pa.array([i for i, n in enumerate(norms) if n], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), pa.array([n for n in norms if n], pa.binary())], names=[key, "norm"])
    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).mapInArrow(normal, f"`{key}` {kind}, norm binary")


def item_fingerprints(classes: DataFrame, gram: int, window: int) -> DataFrame:
    """(cls, h, spot) of each distinct item text."""
    def marks(batches):
        for batch in batches:
            cls, hs, ps = [], [], []
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = n.split(b" ")
                short = (len(words),) if len(words) < window else ()
                h, p = fingerprints(words, gram, window, short, None)
                cls += [c] * len(h)
                hs += h
                ps += p
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.string()), pa.array(hs, pa.int64()),
                                              pa.array(ps, pa.int64())], names=["cls", "h", "spot"])
    return classes.select("cls", "norm").mapInArrow(marks, "cls string, h bigint, spot bigint")


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the runs of true values of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def _extend(window: int):
    def verified(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One document and its candidate diagonals -> its hit words and item classes."""
        out = pd.DataFrame({"_row": pd.Series([], dtype="int64"), "n_hit": pd.Series([], dtype="int64"),
                            "cls": pd.Series([], dtype=object)})
        if not len(left) or not len(right):
            return out
        words = np.array(left["norm"].iloc[0].split(b" "), object)
        edge, found = np.zeros(len(words) + 1, np.int64), []
        for (cls, norm), group in right.groupby(["cls", "item_norm"]):
            item = np.array(norm.split(b" "), object)
            least, hit = min(window, len(item)), False
            for d in group["diagonal"]:
                lo, hi = max(d, 0), min(d + len(item), len(words))
                for a, b in _runs(words[lo:hi] == item[lo - d:hi - d], least):
                    edge[lo + a] += 1
                    edge[lo + b] -= 1
                    hit = True
            if hit:
                found.append(cls)
        n = int((np.cumsum(edge[:-1]) > 0).sum())
        return pd.DataFrame({"_row": [left["_row"].iloc[0]], "n_hit": [n], "cls": [found]}) if found else out
    return verified


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id",
                  text: str = "text", gram: int = GRAM, window: int = WINDOW, sieve: int = SIEVE,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    A word is hit if it lies in an occurrence of a window of any item. Null and empty texts
    have no words and are never hit; null item ids are no items; equal item ids count once.
    Rows with equal or null ids stay apart. Documents are read once; what is kept of them is
    a count, and for those with candidate fingerprints the normalised words.
    """
    if window < gram:
        raise ValueError("window must hold at least one gram")
    spark = prepare(docs.sparkSession)
    named = item_classes(items.filter(F.col(item_key).isNotNull()), item_key, text).distinct()
    named = stored(named.withColumn("cls", F.sha2("norm", 256)), "items")
    classes = named.select("cls", "norm").distinct()
    marks = stored(item_fingerprints(classes, gram, window), "item-marks")
    blanks = F.size(F.split(F.col("norm").cast("string"), " "))
    short = tuple(sorted(r[0] for r in classes.select(blanks.alias("n")).filter(F.col("n") < window)
                         .distinct().collect()))  # at most window - 1 numbers
    few = marks.select("h").distinct().limit(sieve + 1)
    known = None
    if few.count() <= sieve:
        known = np.sort(np.array([r[0] for r in few.toLocalIterator()], np.int64).view(np.uint64))

    kept = [docs.schema[c] for c in (key, *keep)]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def sieved(batches):
        for batch in batches:
            n_words, norms, hs, ps = [], [], [], []
            for t in batch.column(len(kept)).to_pylist():
                words = alnum_words(t)
                h, p = fingerprints(words, gram, window, short, known)
                n_words.append(len(words))
                norms.append(b" ".join(words) if h else None)
                hs.append(h)
                ps.append(p)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(n_words, pa.int64()), pa.array(norms, pa.binary()),
                 pa.array(hs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int64()))],
                names=[*[f.name for f in kept], "n_words", "_norm", "_hs", "_ps"])

    base = docs.select(key, *keep, text).mapInArrow(
        sieved, f"{shape}, n_words bigint, _norm binary, _hs array<bigint>, _ps array<bigint>")
    base = stored(base.withColumn("_row", F.monotonically_increasing_id()), "doc-marks")

    hits = (base.filter(F.size("_hs") > 0).select(F.col("_row").alias("_doc"), F.explode(F.arrays_zip("_hs", "_ps")).alias("m"))
            .select("_doc", F.col("m._hs").alias("h"), F.col("m._ps").alias("at"))
            .join(marks, "h").select("_doc", "cls", (F.col("at") - F.col("spot")).alias("diagonal")).distinct()
            .join(classes.select("cls", F.col("norm").alias("item_norm")), "cls"))
    texts = base.filter(F.size("_hs") > 0).select("_row", F.col("_norm").alias("norm"))
    found = (texts.groupBy("_row").cogroup(hits.groupBy("_doc"))
             .applyInPandas(_extend(window), "_row bigint, n_hit bigint, cls array<string>"))
    found = stored(found, "hits")
    ids = (found.select("_row", F.explode("cls").alias("cls")).join(named.select("cls", item_key), "cls")
           .select("_row", F.col(item_key).cast("string").alias("i")).distinct()
           .groupBy("_row").agg(F.count(F.lit(1)).alias("n_items"),
                                F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("i"))), 256).alias("items_sha256")))
    hit = found.select("_row", "n_hit").join(ids, "_row")
    return (base.select(key, *keep, "n_words", "_row").join(hit, "_row", "left")
            .select(key, *keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))
