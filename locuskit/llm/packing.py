"""Packing documents into sequences: shortest pack first over the length histogram.

Only the histogram of piece lengths (at most ``size`` rows) decides the packing. Lengths are
placed longest first; each goes to the pack with most room left, for all packs of that
pattern at once, so the work does not depend on the number of documents. Patterns are then
joined back to the pieces by their rank within their length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.llm.common import prepare, stored

END_ID = 1
CACHED_WORDS = 1_000_000
ROWS_PER_BUCKET = 5_000
#: Marks that are a token of their own after a letter at the end of a word.
MARKS = b".,!?;:"


class Encoder:
    """Token ids of whole texts; ids of words between ASCII blanks are remembered.

    The tokenizer drops blanks and never joins across them, so a text's ids are those of its
    words one after another; a mark after an ASCII letter is a token of its own too. A text
    that holds a special token's marker is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        raw = (text or "").encode()
        if b"<|" in raw:
            return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()
        words = raw.lower().split()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = {w for w in words if w not in self.known}
        stems = {w: w[:-1] for w in new if w[-1:] in MARKS and w[-2:-1].isalpha()}
        cores = [w for w in (new - stems.keys()) | {*stems.values()} | {w[-1:] for w in stems}
                 if w not in self.known]
        for at in range(0, len(cores), 4096):
            some = cores[at:at + 4096]
            for w, e in zip(some, self.model.encode_batch_fast([w.decode() for w in some],
                                                               add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()
        for w, stem in stems.items():
            self.known[w] = self.known[stem] + self.known[w[-1:]]
        return b"".join([self.known[w] for w in words])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and an end id, cut at ``size``.

    A null text is empty and has only the end id. Repeated rows stay apart.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        enc = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [])
            for i, t in enumerate(batch.column(1).to_pylist()):
                raw = enc.ids(t) + end
                n = len(raw) // 4
                for at in range(0, n, size):
                    part = raw[4 * at:4 * (at + size)]
                    for side, v in zip(out, (i, at, len(part) // 4, zlib.crc32(part), n)):
                        side.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), *[pa.array(s, pa.int64()) for s in out[1:]]],
                names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, {PIECE}")


def plan_packs(histogram: Mapping[int, int], size: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, times), ...]) from length -> number of pieces.

    Each length opens or splits at most one pattern in its last step, so there are at most
    two patterns per length, and a pattern lists each length once.
    """
    open_: list[tuple[int, int, int, list]] = []  # (-room, serial, packs, parts)
    done, serial = [], 0

    def put(room: int, packs: int, parts: list) -> None:
        nonlocal serial
        serial += 1
        if room:
            heapq.heappush(open_, (-room, serial, packs, parts))
        else:
            done.append((packs, parts))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit into {size}")
        while left > 0:
            if not open_ or -open_[0][0] < length:
                put(size - length, left, [(length, 1)])
                break
            room, _, packs, parts = heapq.heappop(open_)
            room = -room
            if left < packs:  # only some packs of the pattern get one
                put(room, packs - left, parts)
                packs, times = left, 1
            else:  # rounds until another pattern has more room
                rival = -open_[0][0] if open_ else 0
                times = max(1, min((room - max(rival, length)) // length + 1, room // length, left // packs))
            left -= packs * times
            last, before = (parts[-1], parts[:-1]) if parts[-1][0] == length else ((length, 0), parts)
            put(room - times * length, packs, [*before, (length, last[1] + times)])
    return done + [(packs, parts) for _, _, packs, parts in open_]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Rank ranges per length: ranks from ``low`` on go ``times`` to each sequence from ``first`` on."""
    rows, taken, first = [], {}, 0
    for packs, parts in patterns:
        offset = 0
        for length, times in parts:
            low = taken.get(length, 0)
            rows.append((length, low, times, first, offset))
            taken[length] = low + packs * times
            offset += length * times
        first += packs
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "times", "first", "offset"), table.T))


def ranked(parts: DataFrame, key: str, most: int) -> DataFrame:
    """Add ``_rank`` from 0 within each length; a frequent length is ranked in many buckets."""
    buckets = 1 + most // ROWS_PER_BUCKET
    spread = parts.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    order = W.partitionBy("length", "_bucket").orderBy(key, "start", "ids_crc32", "doc_tokens")
    return (spread.withColumn("_at", F.row_number().over(order) - 1)
            .join(starts, ["length", "_bucket"])
            .withColumn("_rank", (F.col("_start") + F.col("_at")).cast("bigint"))
            .drop("_bucket", "_at", "_start"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """``pieces`` with sequence_id (from 0 without gaps) and offset in the sequence.

    Texts are tokenized once and the pieces stored. The driver holds only the histogram and
    its patterns, both bounded by ``size``. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    parts = stored(pieces(docs, tokenizer, size, key, text), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan_packs(histogram, size))
    code = where["length"] << 44 | where["low"]
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema[key].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy()
                            for c in ("length", "_rank"))
            at = np.searchsorted(code, length << 44 | rank, side="right") - 1
            step = rank - where["low"][at]
            times = where["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names],
                 pa.array(where["first"][at] + step // times),
                 pa.array(where["offset"][at] + step % times * length)],
                names=[*names, "sequence_id", "offset"])

    return (ranked(parts, key, max(histogram.values(), default=0)).select(*names, "_rank")
            .mapInArrow(placed, f"`{key}` {kind}, {PIECE}, sequence_id bigint, offset bigint"))
