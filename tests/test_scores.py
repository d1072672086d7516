"""Order statistics, scores, samples and labels against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuskit.operators import metrics as me
from locuskit.operators import sampling as sa
from locuskit.operators import stats as st
from locuskit.operators import summaries as su
from locuskit.operators import variants as va
from locuskit.operators.ordered import exact_quantiles, running_totals, take_first, take_first_each, value_counts


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, one value with a third of them."""
    r = random.Random(5)
    data = [("hot" if r.random() < 0.8 else r.choice("xyz"), 7.0 if r.random() < 0.35 else r.gauss(0, 9))
            for _ in range(3000)]
    return data, spark.createDataFrame(data, "k string, v double")


@pytest.mark.parametrize("partitions", ["2", "8", "200"])
def test_quantiles(spark, skewed, partitions):
    data, df = skewed
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = exact_quantiles(value_counts(df, ["k"], "v"), ["k"], "v",
                              {"m": (0.5, "cont"), "d": (0.75, "disc")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for row in out:
        values = sorted(v for k, v in data if k == row.k)
        assert row.total == len(values)
        assert row.m == pytest.approx(statistics.median(values))
        assert row.d == values[math.ceil(0.75 * len(values)) - 1]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    data, df = skewed
    out = running_totals(value_counts(df, ["k"], "v"), ["k"], "v", ["n"], descending).collect()
    for row in out[::50]:
        inside = [v for k, v in data if k == row.k and (v >= row.v if descending else v <= row.v)]
        assert (row.cum_n, row.all_n) == (len(inside), sum(k == row.k for k, _ in data))


@pytest.mark.parametrize("k", [1, 500, 2999, 5000])
def test_take_first_with_hot_ties(spark, k):
    df = spark.range(3000).select((F.col("id") % 7 % 3).alias("a"), "id")
    column = F.lit(k).cast("long")
    got = [r.id for r in take_first(df, column, ["a", "id"]).collect()]
    want = [i for _, i in sorted((i % 7 % 3, i) for i in range(3000))[:k]]
    assert sorted(got) == sorted(want)


def test_auroc_bounds_and_mirror(spark):
    r = random.Random(1)
    data = [(round(r.random(), 2), r.random() < 0.4) for _ in range(500)]
    df = spark.createDataFrame(data, "s double, y boolean")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert me.auroc(df, "s", "y", True).first().auroc == pytest.approx(want)
    assert me.auroc(df, -F.col("s"), "y", True).first().auroc == pytest.approx(1 - want)
    one = df.filter("y")
    assert me.auroc(one, "s", "y", True).first().auroc is None


def test_youden_prefers_the_highest_threshold(spark):
    data = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)]
    df = spark.createDataFrame(data, "s double, y long")
    assert me.youden_cutoff(df, "s", "y", 1).first().cutoff == 0.9
    wrong = spark.createDataFrame([(0.9, 0), (0.1, 1)], "s double, y long")
    assert me.youden_cutoff(wrong, "s", "y", 1).first().cutoff == math.inf
    assert me.mcc(df, "s", "y", 1, 5.0).first().mcc == 0.0


def test_too_few_negatives(spark):
    df = spark.createDataFrame([(1, 0.5, "neg"), (2, 0.7, "pos")], "id long, e double, label string")
    with pytest.raises(Exception, match="fewer than 2 negatives"):
        me.top_abs_with_negatives(df, 2, "neg", "id", "e").collect()
    once = me.top_abs_with_negatives(df, 1, "neg", "id", "e", exclude_top=True)
    assert sorted(r.id for r in once.collect()) == [1, 2]


def step_up(p, pi0=1.0):
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    q, last = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        last = q[i] = min(last, pi0 * m * p[i] / rank)
    return q


@pytest.mark.parametrize("n", [60, 400])
def test_qvalues(spark, n):
    r = random.Random(n)
    p = [min(1.0, round(r.random() ** 2, 3)) for _ in range(n)]
    pi0 = 1.0 if n < 100 else min(1.0, sum(x > 0.94 for x in p) / (n * (1 - 0.94)))
    df = spark.createDataFrame(list(enumerate(p)), "i long, pvalue double")
    got = {row.i: row.qvalue for row in st.qvalues(df, hot_rows=3).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(step_up(p, pi0))
    with pytest.raises(Exception, match="between 0 and 1"):
        st.qvalues(df.withColumn("pvalue", F.lit(1.5))).collect()


def test_bonferroni(spark):
    df = spark.range(1000)
    assert st.bonferroni_cutoff(df) == 1e-4 == st.bonferroni_table(df).first().cutoff
    with pytest.raises(ValueError):
        st.bonferroni_cutoff(df, 1.0)
    with pytest.raises(ValueError):
        st.bonferroni_cutoff(df.limit(0))
    with pytest.raises(Exception, match="no rows"):
        st.bonferroni_table(df.limit(0)).collect()


def test_fold_change_skips_nulls_and_zero_dna(spark, rows):
    df = spark.createDataFrame([(1, 2, 4, None), (0, 0, 3, 5)],
                               "input_rep1 long, input_rep2 long, output_rep1 long, output_rep2 long")
    assert rows(st.mean_fold_change(df), "fold_change") == [(4 / 1.5,), (None,)]


def pchip(x, y, at):
    """Monotone cubic through equally spaced points."""
    h = x[1] - x[0]
    up = np.diff(y) / h
    d = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if up[i - 1] * up[i] > 0:
            d[i] = 2 / (1 / up[i - 1] + 1 / up[i])
    for i, a, b in ((0, up[0], up[1]), (-1, up[-1], up[-2])):
        s = (3 * a - b) / 2
        d[i] = 0 if np.sign(s) != np.sign(a) else 3 * a if np.sign(a) != np.sign(b) and abs(s) > 3 * abs(a) else s
    j = np.clip(np.floor((at - x[0]) / h).astype(int), 0, len(x) - 2)
    t = (at - x[j]) / h
    return (y[j] * (2 * t**3 - 3 * t**2 + 1) + h * d[j] * (t**3 - 2 * t**2 + t)
            + y[j + 1] * (3 * t**2 - 2 * t**3) + h * d[j + 1] * (t**3 - t**2))


def test_score_density(spark):
    r = random.Random(3)
    x = np.array([r.lognormvariate(0, 1) for _ in range(2000)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    n, edges = np.histogram(x, bins=40)
    mass, mids = n / n.sum(), (edges[1:] + edges[:-1]) / 2
    got = sorted(sa.score_density(df, "v", 40, interpolate=True).collect())
    assert [g.pdf for g in got] == pytest.approx(pchip(mids, mass, x), abs=1e-9)
    assert [g.cdf for g in got] == pytest.approx(pchip(mids, np.cumsum(mass), x), abs=1e-9)
    slot = np.clip(np.digitize(x, edges[1:]), 0, 39)
    step = sorted(sa.score_density(df, "v", 40).select("i", "pdf").collect())
    assert [g.pdf for g in step] == pytest.approx(mass[slot])


def test_weighted_sample_is_exact_and_repeatable(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 100, 50.0).otherwise(1.0))
    ids = lambda d: sorted(r.id for r in sa.weighted_sample(d, "w", 0.05, "id", 1).collect())
    one = ids(df)
    assert len(one) == 100 and one == ids(df.repartition(13))
    assert sum(i < 100 for i in one) > 50


def test_lognormal_cdf(spark):
    from locuskit.functions import lognormal_cdf
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 1.0, 5.0)], "x double")
    got = [r[0] for r in df.select(lognormal_cdf(F.col("x"))).collect()]
    want = [0, 0] + [0.5 * (1 + math.erf(math.log(v) / math.sqrt(2))) for v in (0.1, 1.0, 5.0)]
    assert got == pytest.approx(want, abs=2e-7)


def test_histogram_of_one_value(spark):
    out = su.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).collect()
    assert sum(r.n for r in out) == 2 and min(r.bin_lo for r in out) == 1.5


def test_labels(spark, rows):
    data = [(1, 1e-6, 0.5, 20), (2, 1e-6, 0.5, 9), (3, 0.2, 0.01, 20), (4, 0.2, 0.3, 20)]
    df = spark.createDataFrame(data, "id long, mpra_p_value double, mpra_max_log2effect double, mpra_tags long")
    out = rows(va.add_class_labels(df, 1e-5), "id", "label")
    assert out == [(1, "MPRA p≤1e-05"), (2, None), (3, "MPRA p>1e-05"), (4, None)]
    both = va.add_class_labels(df.withColumn("mpra_p_value", F.lit(0.5)), 0.9, 0.1, 0.4, "p", "n")
    assert rows(both, "id", "label") == [(1, "p"), (2, None), (3, "n"), (4, "n")]


def test_relative_effect_by_key_in_any_order(spark, rows):
    data = [("c", 1, "A", "C", 3.0), ("c", 1, "A", "A", 1.0), ("c", 2, "G", "T", 4.0)]
    df = spark.createDataFrame(data, "c string, allele_pos long, ref_allele string, allele string, log2FC double")
    out = va.relative_to_reference(df, keys=["c", "allele_pos"])
    assert rows(out, "allele", "FC_to_ref") == [("A", 0.0), ("C", 2.0), ("T", None)]


@pytest.mark.parametrize("k", [1, 40, 700])
def test_top_of_each_group_by_cutoff(spark, k):
    """A hot group, many ties with the cutoff, a NULL group and NULL values."""
    r = random.Random(k)
    data = [(r.choice(["hot"] * 8 + ["b", None]), r.choice([3.0, 3.0, None, r.gauss(0, 4)]), i) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, v double, id long")
    got = sorted(x.id for x in take_first_each(df, k, ["g"], "v", "id").collect())
    want = []
    for g in ("hot", "b", None):
        want += [i for _, i in sorted((v, i) for h, v, i in data if h == g and v is not None)[:k]]
    assert got == sorted(want)


def test_top_abs_above_the_window_limit(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1009 - 500).cast("double").alias("e"), "id")
    got = sorted(r.id for r in me.top_abs(df, 1500, "e", "id", ["g"]).collect())
    want = []
    for g in range(3):
        want += [i for _, i in sorted((-abs(i * 7919 % 1009 - 500), i) for i in range(9000) if i % 3 == g)[:1500]]
    assert got == sorted(want)
    plan = me.top_abs(df, 1500, "e", "id", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_sample_without_any_weight_is_an_error(spark):
    df = spark.range(100).select("id", (F.col("id") * 0.0).alias("w"))
    with pytest.raises(Exception, match="fewer rows with a weight"):
        sa.weighted_sample(df, "w", 0.5, "id").collect()
    assert sa.weighted_sample(df, "w", 0.001, "id").count() == 0
    half = df.withColumn("w", F.when(F.col("id") < 50, 1.0).otherwise(0.0))
    assert sa.weighted_sample(half, "w", 0.5, "id").count() == 50


def test_checks_of_predictions_in_one_read(spark, rows):
    cols = ("cre_chrom string, cre_start long, cre_end long, bin_chrom string, bin_start long, bin_end long, allele_pos long, "
            "ref_allele string, allele string, log2FC double")
    good = [("c", 10, 12, "c", 8, 14, p, "A", a, 0.0) for p in (10, 11) for a in "ACGT"]
    assert va.check_predictions(spark.createDataFrame(good, cols)).count() == 0
    bad = good + [("c", 10, 12, "c", 9, 14, 20, "A", "A", 0.0)] * 2
    got = rows(va.check_predictions(spark.createDataFrame(bad, cols)), "rule", "detail")
    assert got == [("all_positions_of_element", 3), ("four_alleles", 1), ("one_bin_per_element", 2),
                   ("position_inside_bin", 20), ("position_inside_bin", 20)]
    plan = va.check_predictions(spark.createDataFrame(bad, cols))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_relative_effect_shuffles_once(spark, rows):
    df = spark.createDataFrame([("p", 1, "A", "A", 2.0), ("p", 1, "A", "C", 5.0), ("p", 2, "A", "C", 1.0), (None, 1, "A", "A", 1.0)],
                               "k string, pos int, ref_allele string, allele string, v double")
    out = va.relative_to_reference(df, "v", "d", ["k", "pos"])
    assert rows(out, "k", "pos", "allele", "d") == [("p", 1, "A", 0.0), ("p", 1, "C", 3.0), ("p", 2, "C", None), (None, 1, "A", 0.0)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_mismatches_per_model(spark, rows):
    df = spark.createDataFrame([("m", "A", "A"), ("m", "A", "C"), ("m", "A", None), ("n", "G", "G")],
                               "model string, ref_allele string, pred_ref_allele string")
    assert rows(va.mismatch_counts(df)) == [("m", 3, 2, 1), ("n", 1, 1, 0)]


def test_null_groups_and_tied_series(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("a", float("nan"))], "g string, v double")
    assert sum(r.n for r in su.histogram(df, "v", 4, "g").collect()) == 3
    assert rows(su.box_stats(df.filter("not isnan(v)"), ["g"], "v"), "g", "n")[-1] == (None, 2)


def test_checks_of_predictions_deal_rows_first(spark):
    """Statements are made and counted behind a dealing of the rows, so no task holds those of a whole file."""
    row = ("c", 10, 12, "c", 8, 14, 10, "A", "A", 0.0)
    cols = ("cre_chrom string, cre_start long, cre_end long, bin_chrom string, bin_start long, bin_end long, allele_pos long, "
            "ref_allele string, allele string, log2FC double")
    out = va.check_predictions(spark.createDataFrame([row], cols).coalesce(1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan[plan.rindex("partial_count"):plan.rindex("Scan ")]
    odd = [(None, None, None, "c", None, 14, 10, "A", "A", 0.0), ("c", 10, 12, "d", None, None, None, "A", None, 0.0)]
    found = va.check_predictions(spark.createDataFrame(odd, cols)).select("rule", "chrom", "detail").collect()
    assert sorted(map(tuple, found), key=repr) == [("four_alleles", "c", 1), ("four_alleles", "d", 0)]
