"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through the components of
largest variance, and stored as Parquet rows of one block each: at most ``BLOCK`` vectors, with
the least and greatest value of every component and of the label (the zone map). The product of
an anchor with any vector of a block lies between two sums that interval arithmetic gives from
the zone map alone. A block is read for an anchor only if that interval meets what the anchor
still looks for: at least the seed (the n-th best score within its own block) when positives are
searched, the score windows that the positives set when negatives are. Skipping is never a
guess, so the result is that of a full search.

Anchors travel in chunks of ``CHUNK``, blocks in slices of ``SLICE``. The plan holds the zone
maps of some slices and streams the chunks past them; the search holds one slice and streams
past it the chunks that want blocks of it. Memory is bounded by those sizes, whatever the number
of anchors, and every candidate is shuffled at most once per search.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, prepare, rows_of
from locuskit.llm.hilbert import hilbert_index
from locuskit.llm.vectors import component_ranges, exact_kind, matrix, scaled, whole

#: Vectors of a block, blocks of a slice, anchors of a chunk; slices whose zone maps a task holds.
BLOCK, SLICE, CHUNK, PLANNED = 256, 1024, 512, 16
#: Components that the curve runs through, and bits of each.
CURVE_DIMS, CURVE_BITS = 8, 4
#: Scores computed at a time.
SCORES = 1 << 22
NONE = -(1 << 62)
_TABLE = ("kind int, slice bigint, number int, n int, label_lo bigint, label_hi bigint, ids binary, labels binary, "
          "q binary, lo binary, hi binary, extra binary, more binary")
_NAMES = [c.split()[0] for c in _TABLE.split(", ")]
_BINARY = set(_NAMES[6:])


class Shape:
    """What all tasks must know of the vectors: their length and how products stay exact."""

    def __init__(self, ranges: list):
        self.dims = max(1, len(ranges))
        widest = [max(-r["lo"], r["hi"], 1) for r in ranges] or [1]
        bound = sum(w * w for w in widest)
        if bound >= 1 << 55:
            raise ValueError("products of these vectors do not fit into 64 bits")
        self.kind, self.store = exact_kind(bound), "<i2" if max(widest) < 1 << 15 else "<i4"

    def vectors(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.store).reshape(-1, self.dims).astype(self.kind)


def _longs(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(*shape) if shape else np.frombuffer(raw, "<i8")


def _record(**values) -> pa.RecordBatch:
    """One row of the block table; columns that are not given are null."""
    kinds = {"kind": pa.int32(), "number": pa.int32(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array([values.get(c)], pa.binary() if c in _BINARY else kinds.get(c, pa.int64())) for c in _NAMES],
        names=_NAMES)


def _placed(rows: DataFrame, shape: Shape, ranges: list) -> DataFrame:
    """Add the place on the curve; pack the components."""
    chosen = sorted(ranges, key=lambda r: (-r["spread"], r["pos"]))[:CURVE_DIMS]
    pos, lo = [r["pos"] for r in chosen], np.array([r["lo"] for r in chosen], float)
    width = np.array([max(r["hi"] - r["lo"], 1) for r in chosen], float)

    def run(batches):
        for batch in batches:
            q = matrix(batch.column(3), shape.dims)
            cells = ((q[:, pos] - lo) / width * ((1 << CURVE_BITS) - 1)).round().clip(0, (1 << CURVE_BITS) - 1)
            place = hilbert_index(cells, CURVE_BITS) if pos else np.zeros(len(q), np.int64)
            packed = [row.tobytes() for row in q.astype(shape.store)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place), pa.array(packed, pa.binary())],
                                             names=["id", "label", "anchor", "place", "q"])
    return rows.select("id", "label", "anchor", "q").mapInArrow(
        run, "id bigint, label bigint, anchor boolean, place bigint, q binary")


def _best(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` positions of ``at`` of highest score, ties by position."""
    s = scores[at]
    if len(at) > n:
        least = np.partition(s, len(s) - n)[len(s) - n]
        at, s = at[s >= least], s[s >= least]
    return at[np.argsort(-s, kind="stable")[:n]]


def _blocks(rows: DataFrame, shape: Shape, n_seed: int) -> DataFrame:
    """Rows of kind 0 (blocks with zone maps) and 1 (chunks of anchors with their seeds)."""
    def run(batches):
        part, number, chunks = TaskContext.get().partitionId(), 0, 0
        held, anchors = [], []

        def block():
            ids, labels = (np.array([r[i] for r in held], "<i8") for i in (0, 1))
            raw = b"".join(r[3] for r in held)
            q, place = shape.vectors(raw), part << 20 | number // SLICE
            own = np.array([i for i, r in enumerate(held) if r[2]], np.int64)
            if len(own):
                scores = (q[own] @ q.T).astype(np.int64)
                scores[(labels != labels[own, None]) | (np.arange(len(q)) == own[:, None])] = NONE
                seeds = (np.partition(scores, len(q) - n_seed, 1)[:, len(q) - n_seed] if len(q) >= n_seed
                         else np.full(len(own), NONE))
                anchors.extend((ids[i], labels[i], held[i][3], (place, number << 32 | i), s)
                               for i, s in zip(own.tolist(), seeds.tolist()))
            exact = np.frombuffer(raw, shape.store).reshape(-1, shape.dims)
            return _record(kind=0, slice=place, number=number, n=len(held), label_lo=int(labels.min()),
                           label_hi=int(labels.max()), ids=ids.tobytes(), labels=labels.tobytes(), q=raw,
                           lo=exact.min(0).tobytes(), hi=exact.max(0).tobytes())

        def chunk(some):
            longs = lambda i: np.array([a[i] for a in some], "<i8").tobytes()
            return _record(kind=1, slice=part << 20 | chunks, number=0, n=len(some), ids=longs(0), labels=longs(1),
                           q=b"".join(a[2] for a in some), extra=longs(3), more=longs(4))
        for rows_ in rows_of(batches, "id", "label", "anchor", "q"):
            for row in rows_:
                held.append(row)
                if len(held) == BLOCK:
                    yield block()
                    held, number = [], number + 1
                    if len(anchors) >= CHUNK:
                        yield chunk(anchors[:CHUNK])
                        anchors, chunks = anchors[CHUNK:], chunks + 1
        if held:
            yield block()
        for at in range(0, len(anchors), CHUNK):
            yield chunk(anchors[at:at + CHUNK])
            chunks += 1
    # equal labels and places are still told apart by id, so that a hot one is cut too
    return rows.repartitionByRange("label", "place", "id").sortWithinPartitions("label", "place", "id", "q").mapInArrow(
        run, _TABLE)


class _Chunk:
    """Anchors and what they look for: the seed of each, or the windows of their positives."""

    def __init__(self, row: dict, shape: Shape, window):
        self.id, self.n = row["slice"], row["n"]
        self.ids, self.labels, self.q = _longs(row["ids"]), _longs(row["labels"]), shape.vectors(row["q"])
        self.same = window is None
        if self.same:
            self.at, self.least = _longs(row["extra"], -1, 2), _longs(row["more"])
        else:
            self.positives = _longs(row["extra"], self.n, -1, 2)  # id and score
            there = np.arange(self.positives.shape[1]) < _longs(row["more"])[:, None]
            (low, high, whole_), score = window, self.positives[:, :, 1]
            self.lo = np.where(there, -((-low * score) // whole_), 1)
            self.hi = np.where(there, (high * score) // whole_, 0)
            self.hi = np.where(self.lo <= self.hi, self.hi, NONE)  # empty: nothing is as low

    def wants(self, lo, hi, label_lo, label_hi) -> np.ndarray:
        """Which anchors may find something in which zones."""
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        most = (up @ hi.T + down @ lo.T).astype(np.int64)
        if self.same:
            own = (label_lo <= self.labels[:, None]) & (self.labels[:, None] <= label_hi)
            return own & (most >= self.least[:, None])
        least = (up @ lo.T + down @ hi.T).astype(np.int64)
        meets = np.zeros(most.shape, bool)
        for j in range(self.lo.shape[1]):
            meets |= (most >= self.lo[:, j, None]) & (least <= self.hi[:, j, None])
        return meets & ~((label_lo == label_hi) & (label_lo == self.labels[:, None]))


def _beside(held: DataFrame, streamed: DataFrame, key: str) -> DataFrame:
    """Rows of equal key together, those of ``held`` first."""
    both = held.withColumn("turn", F.lit(0)).unionByName(streamed.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return both.repartition(key).sortWithinPartitions(key, "turn", "slice", "number")


def _groups(batches, names: list[str]):
    """(key, rows as dicts) from batches made by ``_beside``."""
    rows = (dict(zip(names, row)) for some in rows_of(batches, *names) for row in some)
    return groupby(rows, key=lambda r: r[names[0]])


def _plan(blocks: DataFrame, chunks: DataFrame, shape: Shape, window) -> DataFrame:
    """(chunk, at, wanted): the block numbers of slice ``at`` that a chunk must read."""
    names = ["deal", "turn", *_NAMES]
    deals = 1 + blocks.count() // (SLICE * PLANNED)
    zones = blocks.select(F.pmod(F.xxhash64("slice"), F.lit(deals)).alias("deal"), "slice", "number", "label_lo",
                          "label_hi", "lo", "hi")
    dealt = chunks.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))

    def run(batches):
        for _, rows in _groups(batches, names):
            zones, maps = [], None
            for row in rows:
                if row["turn"] == 0:
                    zones.append(row)
                    continue
                if not zones:
                    continue
                if maps is None:
                    slices, number, a, b = (np.array([z[c] for z in zones], np.int64)
                                            for c in ("slice", "number", "label_lo", "label_hi"))
                    maps = (*(shape.vectors(b"".join(z[c] for z in zones)) for c in ("lo", "hi")), a, b)
                some = np.flatnonzero(_Chunk(row, shape, window).wants(*maps).any(0))
                out = [(s, number[some[slices[some] == s]].tolist()) for s in np.unique(slices[some]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["slice"]] * len(out), pa.int64()), pa.array([s for s, _ in out], pa.int64()),
                     pa.array([w for _, w in out], pa.list_(pa.int32()))], names=["chunk", "at", "wanted"])
    return _beside(zones, dealt, "deal").select(
        *[F.col(c) if c in ("deal", "turn", *blocks.columns) else F.lit(None).alias(c) for c in names]).mapInArrow(
        run, "chunk bigint, at bigint, wanted array<int>")


class _Slice:
    """The blocks of a slice that somebody wants, rows in order of their ids."""

    def __init__(self, blocks: list[dict], shape: Shape):
        ids = np.concatenate([_longs(b["ids"]) for b in blocks])
        code = np.concatenate([np.int64(b["number"]) << 32 | np.arange(b["n"]) for b in blocks])
        order = np.argsort(ids, kind="stable")
        self.ids, self.code = ids[order], code[order]
        self.labels = np.concatenate([_longs(b["labels"]) for b in blocks])[order]
        self.q = np.concatenate([shape.vectors(b["q"]) for b in blocks])[order]
        self.number = self.code >> 32

    def search(self, chunk: _Chunk, place: int, wanted: list[int], n: int):
        """(anchor, positive, scores, positions) of the best ``n`` for each anchor or window."""
        at = np.flatnonzero(np.isin(self.number, wanted))
        labels, code, q = self.labels[at], self.code[at], self.q[at]
        step = max(1, SCORES // max(1, len(at)))
        for lo in range(0, chunk.n, step):
            scores = (chunk.q[lo:lo + step] @ q.T).astype(np.int64)
            for i, s in enumerate(scores, lo):
                if chunk.same:
                    fits = (labels == chunk.labels[i]) & (s >= chunk.least[i])
                    if chunk.at[i, 0] == place:
                        fits &= code != chunk.at[i, 1]
                    found = _best(s, np.flatnonzero(fits), n)
                    yield i, 0, s[found], at[found]
                    continue
                other = np.flatnonzero((labels != chunk.labels[i]) & (s >= chunk.lo[i].min()) & (s <= chunk.hi[i].max()))
                for j in range(chunk.lo.shape[1]):
                    inside = other[(s[other] >= chunk.lo[i, j]) & (s[other] <= chunk.hi[i, j])]
                    found = _best(s, inside, n)
                    yield i, j, s[found], at[found]


def _search(blocks: DataFrame, chunks: DataFrame, plan: DataFrame, shape: Shape, window, n: int) -> DataFrame:
    """(chunk, anchor, positive, score, id): the best of each slice for each anchor or window."""
    names = ["at", "turn", "wanted", *_NAMES]
    wanted = plan.select(F.col("at").alias("slice"), F.explode("wanted").alias("number")).distinct()
    held = blocks.join(wanted, ["slice", "number"], "left_semi").withColumn("at", F.col("slice"))
    streamed = chunks.join(plan.withColumnRenamed("chunk", "slice"), "slice")
    shaped = _beside(held, streamed, "at")

    def run(batches):
        for place, rows in _groups(batches, names):
            held, have = [], None
            for row in rows:
                if row["turn"] == 0:
                    held.append(row)
                    continue
                have, held = have or _Slice(held, shape), []
                chunk = _Chunk(row, shape, window)
                found = [f for f in have.search(chunk, place, row["wanted"], n) if len(f[2])]
                size = [len(s) for _, _, s, _ in found]
                if not found:
                    continue
                anchor, positive = (np.repeat([f[i] for f in found], size).astype(np.int32) for i in (0, 1))
                ids = have.ids[np.concatenate([f[3] for f in found])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), chunk.id)), pa.array(anchor), pa.array(positive),
                     pa.array(np.concatenate([f[2] for f in found])), pa.array(ids)],
                    names=["chunk", "anchor", "positive", "score", "id"])
    return shaped.select(names).mapInArrow(run, "chunk bigint, anchor int, positive int, score bigint, id bigint")


def _top(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` over all slices, numbered from 1."""
    order = Window.partitionBy("chunk", "anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _with_positives(chunks: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """Chunks whose ``extra`` has each anchor's positives (id, score) and ``more`` their number."""
    own = positives.groupBy(F.col("chunk").alias("slice")).agg(F.collect_list(F.struct(
        "anchor", F.col("rank").cast("bigint").alias("rank"), "id", "score")).alias("own"))  # at most CHUNK * n

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held, count = np.zeros((row["n"], n, 2), "<i8"), np.zeros(row["n"], "<i8")
                for p in row.pop("own"):
                    held[p["anchor"], p["rank"] - 1] = p["id"], p["score"]
                    count[p["anchor"]] += 1
                yield _record(**row | {"extra": held.tobytes(), "more": count.tobytes()})
    return chunks.join(own, "slice").select(*_NAMES, "own").mapInArrow(run, _TABLE)


def _anchor_ids(chunks: DataFrame) -> DataFrame:
    """(chunk, anchor, anchor_id)."""
    def run(batches):
        for rows in rows_of(batches, "slice", "ids"):
            for chunk, ids in rows:
                ids = _longs(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), chunk)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)],
                    names=["chunk", "anchor", "anchor_id"])
    return chunks.select("slice", "ids").mapInArrow(run, "chunk bigint, anchor int, anchor_id bigint")


def hard_negatives(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30,
                   high: int = 90, whole_share: int = 100, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product with the anchor,
    higher first, ties by smaller key. The positives of an anchor (rows where ``anchors`` is
    true) are its best ``n_positives`` other rows of the same label. For each, the best
    ``n_negatives`` rows of other labels with
    low * positive_score <= whole_share * negative_score <= high * positive_score are returned.

    Rows with a null key, label or vector, or a null or non-finite component, take no part.
    Labels and keys are whole numbers. Vectors of different length are filled up with zeros.
    Rows that repeat a key are rows of their own: an anchor's copy can be its positive, and each
    copy of an anchor has its own results. Anchors without positives, or without negatives in
    the window, have no rows; an empty table gives an empty result. Columns other than the three
    named take no part, whatever their names. Vectors too large for exact 64-bit products raise
    ValueError.
    """
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "hard-negatives")
    fit = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                      F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fit = fit.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("v"))).select(
        "id", "label", "anchor", scaled(F.col("v"), scale).alias("q"))
    ranges = component_ranges(fit, "q")
    shape, window = Shape(ranges), (low, high, whole_share)
    table = scratch.store(_blocks(_placed(fit, shape, ranges), shape, n_positives), "blocks")
    blocks, chunks = table.filter("kind = 0"), table.filter("kind = 1")

    plan = scratch.store(_plan(blocks, chunks, shape, None), "plan-positives")
    positives = scratch.store(_top(_search(blocks, chunks, plan, shape, None, n_positives), n_positives), "positives")
    looking = scratch.store(_with_positives(chunks, positives, n_positives), "windows")
    scratch.drop(plan)
    plan = scratch.store(_plan(blocks, looking, shape, window), "plan-negatives")
    negatives = _top(_search(blocks, looking, plan, shape, window, n_negatives), n_negatives)
    of = positives.select("chunk", "anchor", (F.col("rank") - 1).alias("positive"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score")).join(_anchor_ids(chunks), ["chunk", "anchor"])
    out = scratch.store(negatives.join(of, ["chunk", "anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")), "negatives")
    scratch.drop(table, plan, positives, looking)
    return out
