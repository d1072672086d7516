"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits: bit i is 1 if more than half of the text's shingle hashes have it.
Two fingerprints that differ in at most ``distance`` bits are linked. Cut into
``distance // 2 + 1`` segments, some segment of such a pair differs in at most one bit, so the
pair agrees on that segment with one bit deleted. The index holds, for each distinct fingerprint
and each of its 64 bits, the bit's segment without it; equal entries are joined and the whole
fingerprints compared. Segments that are equal agree on all their variants: such a pair is taken
from the segment's first bit only, any other variant gives the pairs that differ in its bit.

Entries of more than ``crowd`` fingerprints are not paired. Each of their members takes part in
a second index, of the whole fingerprint with ``distance`` bits deleted: members of an entry
there differ in those bits alone, so an entry has at most 2^distance members, all linked, and
every link between two crowded members is in one. The links found are the same either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, blank_words, prepare
from locuskit.llm.components import components

#: Shingles hashed before their bits are counted; a longer text is counted in several steps.
STEP = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def bit_counts(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each of the 64 bits set; number of shingles."""
    k = min(k, len(words))
    n = len(words) - k + 1 if words else 0
    counts, joined = np.zeros(64, np.int64), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        upto = min(n, at + STEP)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1:upto + k - 1].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):  # little-endian: byte 0 has the bits 0 to 7
            counts[8 * byte:8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ _BITS
    return counts, n


def fingerprint(text: str | None, k: int) -> int:
    """The 64 bits as an unsigned number; 0 without words."""
    counts, n = bit_counts(blank_words(text), k)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, print): the fingerprint of each row as a signed long of the same 64 bits."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[key, "print"])
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, print bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segments(distance: int) -> list[range]:
    """The bits of each segment."""
    m = distance // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, distance: int) -> DataFrame:
    """(slot, rest, side, print): per bit, its segment without it; ``side`` is the bit's value.

    ``slot`` is the deleted bit. Of a segment's first bit all pairs count, of others those of
    different sides.
    """
    masks = [sum(1 << b for b in seg if b != bit) for seg in segments(distance) for bit in seg]
    out = prints.select("print", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("slot", "mask"))
    side = F.expr("cast(shiftrightunsigned(print, slot) & 1 as int)")
    return out.select("slot", F.col("print").bitwiseAND(F.col("mask")).alias("rest"), side.alias("side"), "print")


def _crowded_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Links between crowded members, by the fingerprint with ``distance`` bits deleted."""
    masks = [_signed(~sum(1 << b for b in bits) & (1 << 64) - 1) for bits in combinations(range(64), distance)]
    cut = crowded.select("print", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("cut", "mask"))
    held = cut.groupBy("cut", F.col("print").bitwiseAND(F.col("mask")).alias("rest")).agg(
        F.sort_array(F.collect_set("print")).alias("held"))  # at most 2^distance
    return held.filter(F.size("held") > 1).select(
        F.col("held")[0].alias("a"), F.explode(F.slice("held", 2, 1 << distance)).alias("b"))


def links(prints: DataFrame, distance: int, scratch: Scratch, crowd: int = 256) -> DataFrame:
    """(a, b) between distinct fingerprints of column ``print``, enough to connect all that are linked.

    Entries are counted first, so hot ones are reduced before they are shuffled; only the entries
    of several fingerprints are joined with their members.
    """
    index = variants(prints, distance)
    several = scratch.store(index.groupBy("slot", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "entries")
    # merged at every size: the list of entries grows with the input
    members = scratch.store(index.join(several.hint("merge"), ["slot", "rest"]), "members")
    few = members.filter(F.col("n") <= crowd)
    first = [seg[0] for seg in segments(distance)]
    pairs = few.alias("a").join(few.alias("b"), ["slot", "rest"]).filter(
        (F.col("a.print") < F.col("b.print")) & (F.col("slot").isin(first) | (F.col("a.side") != F.col("b.side")))
        & (F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= distance))
    pairs = pairs.select(F.col("a.print").alias("a"), F.col("b.print").alias("b"))
    crowded = members.filter(F.col("n") > crowd).select("print").distinct()
    found = scratch.store(pairs.unionByName(_crowded_links(crowded, distance)).distinct(), "links")
    scratch.drop(several, members)
    return found


def simhash_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, crowd: int = 256,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, component_id) of every row.

    Words are the runs between blanks, A-Z lowered; a shingle is ``k`` words joined by spaces, all
    words where there are fewer, and counts as often as it occurs. Its hash is XXH64 of the UTF-8
    bytes with seed 42. Rows whose fingerprints differ in at most ``distance`` (1 to 3) bits are
    linked, equal ones included, and ``component_id`` is the least key reachable.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Very long texts
    are hashed whole, ``STEP`` shingles at a time. Rows with equal keys stay apart, each with its
    own fingerprint. A null key never names a component with other keys; where all are null it
    is null. An empty table gives an empty result. Columns other than key and text take no part,
    whatever their names. Components are found between distinct fingerprints, so copies cost
    nothing, however many share one.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.store(fingerprints(docs, key, text, k), "fingerprints")
    prints = scratch.store(rows.groupBy("print").agg(F.min(key).alias("least")), "distinct")
    found = links(prints.select("print"), distance, scratch, crowd)
    named = components(found).join(prints.withColumnRenamed("print", "node"), "node")
    named = scratch.store(named, "components")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    several = named.join(roots, "root").select(F.col("node").alias("print"), "component_id")
    of_print = scratch.store(prints.join(several, "print", "left").select(
        "print", F.coalesce("component_id", "least").alias("component_id")), "components-by-print")
    scratch.drop(found, named, prints)
    return rows.join(of_print, "print").select(key, "print", "component_id")


def as_hex(prints: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(prints)), 16, "0")
