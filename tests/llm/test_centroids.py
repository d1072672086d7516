import hashlib

import numpy as np
import pytest

from locuskit.llm.centroids import cluster, digest, nearest

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dims):
    """(id, cluster, distance) of the kept rows and the centroids, every distance measured."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, q in kept:
            far = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
            out.append((i, far.index(min(far)), min(far)))
        return out
    for _ in range(rounds):
        of = [c for _, c, _ in assign()]
        for c in set(of):
            own = [q for (_, q), o in zip(kept, of) if o == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(assign(), key=repr), centroids


def check(spark, rows, k, rounds, dims, **more):
    found, centroids = cluster(frame(spark, rows), k, rounds, dims, **more)
    want, theirs = plain(rows, k, rounds, dims)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=repr) == want
    assert centroids == theirs and [digest(c) for c in centroids] == [digest(c) for c in theirs]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 12))
    rows = [(i, (centre[rng.integers(5)] + 0.1 * rng.normal(size=12)).tolist()) for i in range(400)]
    check(spark, rows, 7, 4, 12)
    check(spark, rows, 7, 2, 12, lead=1)
    check(spark, rows, 7, 2, 12, lead=64)


def test_rows_that_are_not_kept_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [1.0, 2.0, 3.0]),
            (8, [0.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [-1.0, 3.0]), (None, [0.5, 0.5]),
            (None, None), (11, [-0.001, 0.001])]
    check(spark, rows, 3, 3, 2)
    check(spark, rows, 40, 2, 2)


def test_equal_vectors_and_empty_clusters(spark):
    check(spark, [(i, [0.25, -0.75, 1.5]) for i in range(50)] + [(99, [3.0, 0.0, 0.0])], 6, 3, 3)


def test_empty_table(spark):
    found, centroids = cluster(frame(spark, []), 4, 2, 3)
    assert found.collect() == [] and centroids == [] and found.columns[0] == "vec_id"
    assert cluster(frame(spark, [(1, None)]), 4, 2, 3)[0].collect() == []


def test_sizes_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="below"):
        cluster(frame(spark, [(1, [1e30, 1.0])]), 1, 1, 2)


def test_bound_spares_most_measurements():
    rng = np.random.default_rng(2)
    c = rng.integers(-2000, 2000, (40, 8))
    q = c[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 8))
    axes = np.eye(8)[:, :3]
    first, rest = q @ axes, np.sqrt(((q @ np.eye(8)[:, 3:]) ** 2).sum(1))
    c_first, c_rest = c @ axes, np.sqrt(((c @ np.eye(8)[:, 3:]) ** 2).sum(1))
    number, far, measured = nearest(q, first, rest, c, c_first, c_rest)
    d = ((q[:, None, :] - c) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (far == d.min(1)).all() and measured.mean() < 3
