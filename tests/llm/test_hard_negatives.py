import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuskit.llm import hard_negatives as hn
from locuskit.llm.hilbert import hilbert_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, q int, place string, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash", 1, "x", 2) for i, v, c in rows], SCHEMA)


def plain(rows, every, n_pos=5, n_neg=10):
    kept = [(i, c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, c, q) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), j, d) for b, (j, d, r) in enumerate(kept) if b != a]
        for s, j, _ in sorted(x[:2] + (0,) for x in scored if x[2] == c)[:n_pos]:
            fits = sorted((t, k) for t, k, d in scored if d != c and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def check(spark, rows, every, **more):
    found = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain(rows, every, *more.values())
    return got


def drawn(seed, n, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dims))
    return [(i, (centre[rng.integers(8)] + 0.3 * rng.normal(size=dims)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (2, 1), (4, 2), (1, 3)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_equals_brute_force_over_several_blocks(spark):
    assert check(spark, drawn(1, 1500), 20)
    assert check(spark, drawn(2, 400, labels=2), 3, n_positives=2, n_negatives=4)


def test_small_blocks_slices_and_chunks(spark, monkeypatch):
    for name, size in (("BLOCK", 8), ("SLICE", 3), ("CHUNK", 5), ("PLANNED", 2)):
        monkeypatch.setattr(hn, name, size)
    assert check(spark, drawn(3, 500), 10)


def test_rows_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (0, [0.5, 0.5], 1),
            (3, [0.5, 0.25], 2), (4, [0.5, 0.25], 3), (5, [0.5, 0.25], 2), (5, [0.5, 0.25], 2), (6, None, 2), (7, [nan, 1.0], 2),
            (8, [inf, 1.0], 2), (9, [None, 1.0], 2), (10, [0.4, 0.4], None), (None, [0.5, 0.3], 2), (11, [0.6], 2), (12, [], 2),
            (13, [-1.0, -1.0], 1), (100, [0.0, 0.0], 5), (200, [-1.0, 2.0], 6), (201, [1.0, -2.0], 6)]
    assert check(spark, rows, 100)
    assert check(spark, rows, 1)


def test_one_vector_holds_a_third_of_all_rows(spark):
    rows = drawn(4, 600)
    rows += [(10_000 + i, rows[0][1], rows[0][2] if i % 2 else 9) for i in range(300)]
    assert check(spark, rows, 50)


def test_empty_tables(spark):
    assert check(spark, [], 1) == []
    assert check(spark, [(1, None, 1), (2, [1.0], None)], 1) == []
    assert check(spark, [(i, [], i % 2) for i in range(6)], 1)
    assert check(spark, drawn(5, 50), 1000, n_positives=5) == plain(drawn(5, 50), 1000)


def test_zone_maps_spare_blocks(spark):
    """Of well separated groups, anchors want few blocks."""
    rng = np.random.default_rng(6)
    rows = [(i, (5 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)).tolist(), i % 2) for i in range(8 * 300)]
    df = frame(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"),
                                   (F.col("vec_id") % 100 == 0).alias("anchor"), hn.scaled(F.col("embedding")).alias("q"))
    ranges = hn.component_ranges(df, "q")
    shape = hn.Shape(ranges)
    table = hn._blocks(hn._placed(df, shape, ranges), shape, 5).cache()
    blocks, chunks = table.filter("kind = 0"), table.filter("kind = 1")
    n_blocks, n_chunks = blocks.count(), chunks.count()
    plan = hn._plan(blocks, chunks, shape, None)
    assert plan.selectExpr("sum(size(wanted))").first()[0] < 0.7 * n_blocks * n_chunks


def test_sizes_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        hn.hard_negatives(frame(spark, [(1, [1e8, 1.0], 1)]), F.lit(True))
