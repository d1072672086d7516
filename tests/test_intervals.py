"""Bucketed joins against brute force, for any width and for hot buckets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from locuskit.operators import coverage as co
from locuskit.operators import intervals as iv
from locuskit.operators.band import range_join
from locuskit.operators.joins import add_split_flags, infill, partitioned_join, semi_by_list, skew_join
from locuskit.sources import colocated as cl


def make(spark, seed, n=120, hot=False):
    r = random.Random(seed)
    spans = [("a" if r.random() < 0.5 else "b", s := r.randint(-500, 3000), s + r.choice([0, 9, 300, 2500]))
             for _ in range(n)]
    points = [("a" if r.random() < 0.5 else "b", 77 if hot and r.random() < 0.4 else r.randint(-600, 6000))
              for _ in range(n)]
    return (spans, points, spark.createDataFrame(spans, "chrom string, lo long, hi long"),
            spark.createDataFrame(points, "chrom string, at long"))


@pytest.mark.parametrize("widths", [(1,), (64,), (256,), (100000,), (16, 256, 4096)])
@pytest.mark.parametrize("hot_rows", [None, 5])
def test_bucketed_equals_theta(spark, rows, widths, hot_rows):
    spans, points, s, p = make(spark, len(widths) + widths[0], hot=True)
    got = iv.bucketed_join(s, p, F.col("lo"), F.col("hi"), F.col("at"), widths=widths,
                           hot_rows=hot_rows).select("l.chrom", "l.lo", "l.hi", "r.at")
    want = sorted(((c, lo, hi, at) for c, lo, hi in spans for d, at in points
                   if c == d and lo <= at <= hi), key=repr)
    assert rows(got) == want


def test_salts_split_a_hot_key(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    out = skew_join(left, right, ["k"], hot_rows=100)
    assert out.count() == 200_000
    assert out.select(F.col("l._sa")).distinct().count() == 8


def test_contained_edges(spark, rows):
    bins = spark.createDataFrame([("c", 100, 400, 1.0)], "chrom string, start long, end long, log2FC double")
    hits = [("c", 100, 110), ("c", 390, 400), ("c", 391, 401), ("c", 99, 120), ("d", 150, 160)]
    feats = spark.createDataFrame([(c, s, e, "m1", "m1.X") for c, s, e in hits],
                                  "chrom string, start long, stop long, motif_id string, motif_alt_id string")
    assert rows(iv.contained_join(bins, feats), "mot_start", "mot_stop", "motif_name") == [
        (100, 110, "X"), (390, 400, "X")]


def test_distance_limit_and_long_motif(spark, rows):
    data = [("c", 0, 10, "a", "noname"), ("c", 10, 20, "b", "b.2.B"), ("c", 990, 1000, "d", "d.D"),
            ("c", 991, 1001, "e", "e.E"), ("c", 5000, 9000, "f", "f.F")]
    feats = spark.createDataFrame(data, "chrom string, start long, stop long, motif_id string, motif_alt_id string")
    got = rows(iv.within_distance_join(feats, 1000), "motif_id", "motif2_id", "motif_name", "motif_distance")
    assert got == [("a", "d", "", 990), ("b", "d", "B", 980), ("b", "e", "B", 981)]


COVERAGE = [("E", "r", "c", 0, 99, 100, 1, 2, 10, 20, 11, 11.0), ("E", "r", "c", 0, 99, 100, 2, 3, 40, 50, 11, 11.0),
            ("E", "r", "c", 0, 99, 100, 3, 4, 40, 45, 6, 6.0), ("E", "r", "c", 0, 99, 100, 4, 5, 51, 60, 10, 10.0),
            ("E", "none", "c", 200, 299, 100, None, None, None, None, None, None)]
SCHEMA = ("region_type string, region string, chrom string, start_pos long, end_pos long, region_length long, "
          "cre_start long, cre_end long, pred_start long, pred_end long, pred_length long, region_cov double")


def test_gaps_tile_the_region(spark, rows):
    c = spark.createDataFrame(COVERAGE, SCHEMA)
    assert rows(co.gap_before(c), "region_id", "region_length") == [("c:0-10", 10)]
    assert rows(co.gap_after(c), "region_id") == [("c:61-100",)]
    assert rows(co.gap_after(c, compat=True), "region_id") == [("c:60-100",)]
    # one row for each gap, however many elements start behind it; 46 to 51 is covered by 40 to 50
    assert rows(co.gaps_between(c), "region_id") == [("c:21-40",)]
    assert rows(co.gaps_between(c, compat=True), "region_id").count(("c:21-40",)) == 2
    assert rows(co.missing_parts(c), "region_id") == [("c:0-10",), ("c:21-40",), ("c:61-100",)]
    assert ("c:51-51", 0) in rows(co.gaps_between(c, compat=True), "region_id", "region_length")
    assert rows(co.unmatched_regions(c), "region_id") == [("c:200-300",)]


def test_gap_across_stretches(spark, rows):
    far = 3 * co.STRETCH
    data = [("E", "r", "c", 0, far + 9, far + 10, 1, 2, 5, 6, 2, 0.0),
            ("E", "r", "c", 0, far + 9, far + 10, 2, 3, far, far + 9, 10, 0.0)]
    assert rows(co.gaps_between(spark.createDataFrame(data, SCHEMA)), "region_id") == [(f"c:7-{far}",)]


def test_split_flags(spark, rows):
    bins = spark.createDataFrame([(1, "c", 0, 9), (2, "c", 5, 14)], "index long, chrom string, start long, end long")
    good = bins.filter("index = 1")
    assert rows(add_split_flags(bins, {"train": good}), "index", "train") == [(1, True), (2, False)]
    with pytest.raises(Exception, match="index mismatch"):
        add_split_flags(bins, {"train": good.withColumn("start", F.lit(3).cast("long"))}).collect()


def test_infill_and_semi(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k long, v string")
    assert rows(infill(a, b, ["k"])) == [(1, "x"), (2, "z"), (2, "z")]
    pairs = spark.createDataFrame([("p", "q"), ("q", "q"), ("r", "s")], "m string, n string")
    wanted = spark.createDataFrame([("q",)], "id string")
    assert rows(semi_by_list(pairs, ["m", "n"], wanted, "id")) == [("p", "q"), ("q", "q")]


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    from locuskit.session import cut_lineage, scratch_path
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/shared")
    assert f"{tmp_path}/shared" in scratch_path(spark, "x")
    assert cut_lineage(spark.range(5)).count() == 5


@pytest.mark.parametrize("hot", [False, True])
def test_nested_bins_for_any_length(spark, rows, hot):
    r = random.Random(8)
    spans = [("a" if r.random() < 0.6 else "b", s := r.randrange(-10 ** 6, 10 ** 8), s + 10 ** r.randrange(9)) for _ in range(150)]
    points = [("a" if r.random() < 0.6 else "b", 77 if hot and r.random() < 0.4 else r.randrange(-10 ** 6, 2 * 10 ** 8)) for _ in range(400)]
    s = spark.createDataFrame(spans, "chrom string, lo long, hi long")
    p = spark.createDataFrame(points, "chrom string, at long")
    got = iv.bucketed_join(s, p, F.col("lo"), F.col("hi"), F.col("at")).select("l.chrom", "l.lo", "l.hi", "r.at")
    assert rows(got) == sorted(((c, lo, hi, at) for c, lo, hi in spans for d, at in points if c == d and lo <= at <= hi), key=repr)
    most = iv.interval_bins(s.distinct(), F.col("lo"), F.col("hi")).groupBy("chrom", "lo", "hi").count().agg(F.max("count")).first()[0]
    assert most <= 17


def test_positions_look_only_into_used_levels(spark):
    s = spark.createDataFrame([("a", 5, 25), ("a", 9, 3)], "chrom string, lo long, hi long")
    p = spark.createDataFrame([("a", 10)], "chrom string, at long")
    used = s.filter("hi >= lo").agg(F.collect_set(iv._level(F.col("hi") - F.col("lo"), iv.LEVELS))).scalar()
    assert iv.position_bins(p, F.col("at"), used=used).count() == 1
    assert iv.position_bins(p, F.col("at")).count() == len(iv.LEVELS)


@pytest.mark.parametrize("piece_rows", [3, 40, 10_000])
def test_range_join_with_hot_values(spark, rows, piece_rows):
    r = random.Random(piece_rows)
    left = [("a" if r.random() < 0.7 else r.choice(["b", None]), i, lo := r.choice([1.5, r.gauss(0, 5)]), lo + r.choice([-1, 0, 0.5, 30])) for i in range(150)]
    right = [("a" if r.random() < 0.7 else r.choice(["b", None]), i, r.choice([1.5, 1.5, r.gauss(0, 5), None])) for i in range(150)]
    a = spark.createDataFrame(left, "k string, i long, lo double, hi double")
    b = spark.createDataFrame(right, "k string, j long, x double")
    got = range_join(a, b, F.col("lo"), F.col("hi"), F.col("x"), ["k"], F.col("l.i") != F.col("r.j"), piece_rows)
    assert rows(got, "l.i", "r.j") == sorted(((i, j) for k, i, lo, hi in left for m, j, x in right
                                             if k is not None and k == m and x is not None and lo <= x <= hi and i != j), key=repr)
    # the parts of a piece stay near the stated size
    parts = got.groupBy("l.k", "l._piece", "l._sl", "l._sr").agg(F.count_distinct("l.i").alias("m"), F.count_distinct("r.j").alias("n"))
    top = parts.agg(F.max("m"), F.max("n")).first()
    assert max(top) <= 3 * piece_rows + 4


def test_range_form_of_the_partitioned_join(spark, rows):
    a = spark.createDataFrame([("p", 1.0, 2.0), (None, 0.0, 9.0), ("q", 0.0, 1.0)], "k string, lo double, hi double")
    b = spark.createDataFrame([("p", 1.5), ("q", 1.5), ("p", 2.5)], "k string, x double")
    out = partitioned_join(a, b, "k", None, [F.col("l.k"), F.col("r.x")], between=(F.col("lo"), F.col("hi"), F.col("x")))
    assert rows(out) == [("p", 1.5)]
    free = partitioned_join(a, b.drop("k"), "k", None, [F.col("l.k"), F.col("r.x")], between=(F.col("lo"), F.col("hi"), F.col("x")))
    assert rows(free) == [("p", 1.5), ("p", 1.5)]


def sweep(stretches, lo, hi):
    covered = {p for a, b in stretches for p in range(a, b + 1)}
    free = [p for p in range(lo, hi + 1) if p not in covered]
    starts = [p for p in free if p - 1 not in free]
    return [f"c:{p}-{next(q for q in range(p, hi + 2) if q not in free)}" for p in starts]


def test_missing_parts_equal_single_positions(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "STRETCH", 16)  # many parts, with nested, tied and touching stretches
    r = random.Random(3)
    data, want = [], []
    for n in range(40):
        lo, hi = 100 * n, 100 * n + 79
        some = [(a := r.randrange(lo, hi), min(hi, a + r.choice([0, 1, 5, 40]))) for _ in range(r.randrange(1, 7))]
        some += some[:1]
        data += [("E", f"r{n}", "c", lo, hi, 80, a, b, a, b, b - a + 1, 0.0) for a, b in some]
        want += [(f"r{n}", g) for g in sweep(some, lo, hi)]
    c = spark.createDataFrame(data, SCHEMA)
    assert rows(co.missing_parts(c), "region", "region_id") == sorted(want, key=repr)
    inner = [(x, g) for x, g in want if int(g.split(":")[1].split("-")[0]) % 100 and int(g.split("-")[1]) % 100 != 80]
    assert rows(co.gaps_between(c), "region", "region_id") == sorted(inner, key=repr)
    plan = co.missing_parts(c)._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\([^)]*\)[^,]*, \[plan_id=(\d+)", plan))) <= 4


def test_stored_tables_join_without_an_exchange(spark, rows, tmp_path):
    spans, points, s, p = make(spark, 5, hot=True)
    a = cl.store_intervals(s, "colocated_a", f"{tmp_path}/a", F.col("lo"), F.col("hi"), buckets=4)
    b = cl.store_positions(p, "colocated_b", f"{tmp_path}/b", F.col("at"), buckets=4)
    out = cl.stored_join(a, b).select("l.chrom", "l.lo", "l.hi", "r.at")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == sorted(((c, lo, hi, at) for c, lo, hi in spans for d, at in points if c == d and lo <= at <= hi), key=repr)
    cl.drop_stored(spark, "colocated_a", "colocated_b")


def test_absent_split_id_and_gaps_of_one_region(spark):
    bins = spark.createDataFrame([(1, "c", 0, 9)], "index long, chrom string, start long, end long")
    with pytest.raises(Exception, match="no bin for split"):
        add_split_flags(bins, {"train": bins.withColumn("index", F.lit(7).cast("long"))}).collect()


def test_loose_gaps_are_dealt_once(spark, rows):
    """Collapsing, windows and the join of the loose gaps use one dealing by region and part."""
    data = [("E", "r", "c", 0, 99, 100, i, i + 5, i, i + 4, 5, 5.0) for i in (10, 10, 30, 60)]
    out = co.gaps_between(spark.createDataFrame(data, SCHEMA), compat=True)
    assert rows(out, "region_id") == [("c:15-30",)] * 2 + [("c:35-60",)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "region_type" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
