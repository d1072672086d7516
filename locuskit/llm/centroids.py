"""Centroid clustering (Lloyd's rounds) with PCA-rotated filtering.

Vectors are rotated to the principal axes of the whole table. Stored with each vector are its
``lead`` leading rotated coordinates and the norm of the rest. For a centroid rotated likewise,
the squared distance of the leading parts plus the squared difference of the two rest norms is
a lower bound of the squared distance. The centroid of least bound is measured in integers;
only those whose bound does not exceed that distance can be nearer or tie, and they are measured
in integers too. The rotation thus decides how much is measured, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, prepare
from locuskit.llm.vectors import component_ranges, matrix, scaled, whole

#: Room for rounding in the bound, as a share of the squared norms that enter it.
ROOM = 1e-6
#: Squared distances must fit into 64 bits, and so must a task's sums.
WIDEST = 1 << 27


def principal_axes(rows: DataFrame, dims: int, mean: np.ndarray, lead: int) -> np.ndarray:
    """The ``lead`` leading eigenvectors of the covariance over all rows, as columns.

    Each task adds up its products; the driver gets dims x dims sums.
    """
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims * dims), pa.int32()), pa.array(total.reshape(-1))], names=["at", "s"])
    sums = rows.select("q").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(dims * dims)
    for r in sums:
        total[r["at"]] = r["s"]
    return np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1][:, :lead]


def _rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    x = x - mean
    first = x @ axes
    return first, np.sqrt(np.maximum((x * x).sum(1) - (first * first).sum(1), 0))


def nearest(q: np.ndarray, first: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            c_first: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, centroids measured) of each row of ``q``; ties: smaller number."""
    own, theirs = (first * first).sum(1), (c_first * c_first).sum(1)
    bound = own[:, None] + theirs - 2 * (first @ c_first.T) + (rest[:, None] - c_rest) ** 2
    near = bound.argmin(1)
    best = ((q - centroids[near]) ** 2).sum(1)
    room = ROOM * (1 + own[:, None] + rest[:, None] ** 2 + theirs + c_rest ** 2)
    at, c = np.nonzero(bound <= best[:, None] + room)
    measured = np.full(bound.shape, np.iinfo(np.int64).max)
    for lo in range(0, len(at), 1 << 14):
        a, b = at[lo:lo + (1 << 14)], c[lo:lo + (1 << 14)]
        measured[a, b] = ((q[a] - centroids[b]) ** 2).sum(1)
    number = measured.argmin(1)
    return number, measured[np.arange(len(q)), number], np.bincount(at, minlength=len(q))


class _Assign:
    """The centroids of one round, as tasks use them."""

    def __init__(self, centroids: list[list[int]], mean: np.ndarray, axes: np.ndarray):
        self.centroids, self.dims = np.array(centroids, np.int64), len(mean)
        self.first, self.rest = _rotated(self.centroids, mean, axes)

    def __call__(self, batch: pa.RecordBatch):
        at = batch.schema.get_field_index
        q = matrix(batch.column(at("q")), self.dims)
        first = matrix(batch.column(at("first")), self.first.shape[1], np.float64)
        return q, *nearest(q, first, batch.column(at("rest")).to_numpy(), self.centroids, self.first, self.rest)


def _sums(rows: DataFrame, assign: _Assign) -> list:
    """(cluster, n, s0, s1, ...): exact sums over each cluster, one row for each."""
    dims, k = assign.dims, len(assign.centroids)

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q, number, _, _ = assign(batch)
            np.add.at(total, number, q)
            count += np.bincount(number, minlength=k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "s"])
    parts = rows.select("q", "first", "rest").mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


def cluster(rows: DataFrame, k: int, rounds: int, dims: int, key: str = "vec_id", vector: str = "embedding",
            scale: int = 256, salt: str = "2:", lead: int = 16) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance, n_measured) of every kept row, final centroids).

    Kept are vectors of exactly ``dims`` components, none null or non-finite; others are left
    out, null vectors included. Components become floor(scale * x). The first centroids are the
    ``k`` kept vectors of smallest sha256 hex of ``salt`` and key (null key: empty), equal keys
    by their components. Each round assigns all rows to the nearest centroid (squared distance,
    ties: smaller number) and moves non-empty ones to the floor of their mean. With fewer kept
    rows than ``k`` there are as many centroids as rows; without any, the result is empty.
    Repeated rows count as often as they occur. Columns other than key and vector take no part,
    whatever their names. Sizes of ``WIDEST`` and more raise ValueError; longer vectors are not
    cut, they are not kept.

    The driver holds the centroids, k x dims sums a round and a dims x dims covariance; every
    round is one scan of the stored rows, without a shuffle of them.
    """
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "centroids")
    kept = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(
        whole(F.col("v")) & (F.size("v") == dims)).select("id", scaled(F.col("v"), scale).alias("q"))
    ranges = component_ranges(kept, "q")
    if any(max(-r["lo"], r["hi"]) >= WIDEST for r in ranges):
        raise ValueError(f"vector components must be below {WIDEST} in size")
    if not ranges:
        return spark.createDataFrame(
            [], f"`{key}` {rows.schema[key].dataType.simpleString()}, cluster int, distance bigint, n_measured int"), []
    mean = np.array([r["mean"] for r in ranges])
    axes = principal_axes(kept, dims, mean, min(lead, dims))

    def rotate(batches):
        for batch in batches:
            first, rest = _rotated(matrix(batch.column(1), dims), mean, axes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first.tolist(), pa.list_(pa.float64())), pa.array(rest)],
                names=["id", "q", "first", "rest"])
    kind = rows.schema[key].dataType.simpleString()
    turned = scratch.store(kept.mapInArrow(rotate, f"id {kind}, q array<bigint>, first array<double>, rest double"), "rotated")
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [list(r["q"]) for r in turned.select("q", mark.alias("mark")).orderBy("mark", "q").limit(k).collect()]
    for _ in range(rounds):
        for r in _sums(turned, _Assign(centroids, mean, axes)):
            if r["n"]:
                centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    last = _Assign(centroids, mean, axes)

    def run(batches):
        for batch in batches:
            _, number, distance, measured = last(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array(number, pa.int32()), pa.array(distance),
                 pa.array(measured, pa.int32())], names=["id", "cluster", "distance", "n_measured"])
    out = scratch.store(turned.mapInArrow(run, f"id {kind}, cluster int, distance bigint, n_measured int"), "assigned")
    scratch.drop(turned)
    return out.withColumnRenamed("id", key), centroids


def digest(centroid: list[int]) -> str:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
