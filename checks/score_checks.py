"""Statistics, scoring of predictions, summaries of distributions, sampling."""

from pyspark.sql import functions as F

from checks.recipes import features, labelled, replicates, sql, table
from checks.registry import check
from checks.variant_checks import LABELS, MATCHED, labelled_variants, rounded
from locuskit.operators import metrics as me
from locuskit.operators import sampling as sa
from locuskit.operators import stats as st
from locuskit.operators import summaries as su
from locuskit.operators.ordered import exact_quantiles, take_first, value_counts

UNIT = ("((cast(('0x' || substr(md5({0} || '|{1}'), 1, 13)) as bigint) + 0.5::double) "
        "/ 4503599627370496.0::double)")


def price_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")


@check("quantile_stats", """select l_returnflag, count(*) as total,
    quantile_disc(l_extendedprice, 0.75) as q75, quantile_disc(l_extendedprice, 0.95) as q95,
    round(median(l_extendedprice), 6) as med, round(quantile_cont(l_extendedprice, 0.1), 6) as d1
    from lineitem group by l_returnflag""")
def _(spark, sf):
    counts = value_counts(price_keys(spark, sf), ["l_returnflag"], "l_extendedprice")
    out = exact_quantiles(counts, ["l_returnflag"], "l_extendedprice", {
        "q75": (0.75, "disc"), "q95": (0.95, "disc"), "med": (0.5, "cont"), "d1": (0.1, "cont")})
    return rounded(out, "med", "d1", digits=6)


@check("bonferroni", """select n as tests, 0.05::double / n as exact,
    pow(10.0::double, trunc(log10(0.05::double / n))) as cutoff from (select count(*) as n from events)""")
def _(spark, sf):
    return st.bonferroni_table(table(spark, sf, "events"))


STEP_UP = """, c as (select p, count(*) as n from tests group by p),
    r as (select p, sum(n) over (order by p) as cum, sum(n) over () as m from c),
    s as (select least(1, coalesce(sum(n) filter (p > 0.94::double), 0)
    / (sum(n) * (1 - 0.94::double))) as pi0 from c),
    w as (select p, least(pi0 * cast(m as double) * p / cast(cum as double),
    case when cum = m then 1.0::double end) as raw from r, s),
    q as (select p, round(min(raw) over (order by p desc rows unbounded preceding), 9) as qvalue
    from w)"""


@check("qvalues", sql("features", "") + ", tests as (select *, pvalue as p from features)" + STEP_UP
       + " select chrom, start, pvalue, qvalue from tests join q using (p)")
def _(spark, sf):
    f = features(spark, sf).select("chrom", "start", "pvalue")
    return rounded(st.qvalues(f), "qvalue")


TIED = """tests as (select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then 1.0::double
    else l_partkey * l_partkey % 997 / 2000.0::double end as p from lineitem)"""


def tied_p(spark, sf):
    part = F.col("l_partkey")
    p = F.when(part % 3 == 0, F.lit(1.0)).otherwise(part * part % 997 / F.lit(2000.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))


@check("qvalues_tied", "with " + TIED + STEP_UP
       + " select l_orderkey, l_linenumber, p, qvalue from tests join q using (p)")
def _(spark, sf):
    return rounded(st.qvalues(tied_p(spark, sf), "p"), "qvalue")


@check("p_cutoff", "with " + TIED + """ select min(p) as p_min,
    pow(10.0::double, trunc(log10(min(p)))) as cutoff from tests where round(p, 2) = 0.05::double""")
def _(spark, sf):
    return st.p_at_q(tied_p(spark, sf), 0.05, "p", "p")


@check("library_norm", sql("replicates", """select l_orderkey, l_linenumber, l_partkey,
    round(input_rep1 / sum(input_rep1) over () * 1e6, 6) as a,
    round(input_rep2 / sum(input_rep2) over () * 1e6, 6) as b,
    round(output_rep1 / sum(output_rep1) over () * 1e6, 6) as c,
    round(output_rep3 / sum(output_rep3) over () * 1e6, 6) as d from replicates"""))
def _(spark, sf):
    out = st.normalize_by_library(replicates(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[
        F.round(f"{c}_norm", 6).alias(a) for c, a in zip(
            ["input_rep1", "input_rep2", "output_rep1", "output_rep3"], "abcd")])


@check("library_sizes", sql("replicates", """select replicate, round(sum(v), 3) as size from (
    select unnest(['input_rep1', 'input_rep2', 'output_rep1', 'output_rep2', 'output_rep3'])
    as replicate, unnest([input_rep1, input_rep2, output_rep1, output_rep2, output_rep3]) as v
    from replicates) group by replicate"""))
def _(spark, sf):
    return rounded(st.library_sizes(replicates(spark, sf)), "size", digits=3)


@check("fold_change", sql("replicates", """select l_orderkey, l_linenumber, l_partkey,
    round((case when output_rep1 is null then (output_rep2 + output_rep3) / 2
    else (output_rep1 + output_rep2 + output_rep3) / 3 end + 1)
    / ((input_rep1 + input_rep2) / 2 + 1), 6) as fold_change from replicates"""))
def _(spark, sf):
    out = st.mean_fold_change(replicates(spark, sf), 1.0)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "fold_change"),
                   "fold_change", digits=6)


@check("zscore", """select event_id, round((value - avg(value) over ()) / stddev_pop(value) over (), 6)
    as zscore from events""")
def _(spark, sf):
    return rounded(st.zscore(table(spark, sf, "events").select("event_id", "value"), "value")
                   .drop("value"), "zscore", digits=6)


CURVE = """, k as (select lang, score, count(*) filter (quality = 1) as pos,
    count(*) filter (quality = 0) as neg from labelled group by lang, score),
    t as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by lang)
    as ap, sum(neg) over (partition by lang) as an from k window w as (partition by lang
    order by score desc rows unbounded preceding)),
    points as (select lang, cast(cn as double) / nullif(an, 0) as fpr,
    cast(cp as double) / nullif(ap, 0) as tpr, score as threshold from t union all
    select distinct lang, 0.0::double, 0.0::double, 'inf'::double from labelled)"""


@check("roc_points", sql("labelled", "") + CURVE + " select * from points")
def _(spark, sf):
    return me.roc_points(labelled(spark, sf), "score", "quality", 1, ["lang"])


@check("auroc", sql("labelled", "") + CURVE + """ select lang, cast(max(ap) as bigint) as positives,
    cast(max(an) as bigint) as negatives, round(sum(pos * (an - cn + neg / 2.0::double))
    / nullif(max(ap) * max(an), 0), 9) as auroc from t group by lang""")
def _(spark, sf):
    return rounded(me.auroc(labelled(spark, sf), "score", "quality", 1, ["lang"]), "auroc")


CUT = """, cut as (select * from (select *, row_number() over (partition by lang
    order by tpr - fpr desc nulls last, threshold desc) as rn from points) where rn = 1)"""


@check("youden_cutoff", sql("labelled", "") + CURVE + CUT
       + " select lang, threshold as cutoff, tpr, fpr from cut")
def _(spark, sf):
    return me.youden_cutoff(labelled(spark, sf), "score", "quality", 1, ["lang"])


@check("mcc_at_youden", sql("labelled", "") + CURVE + CUT + """ select lang, tp, fp, fn, tn,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp)
    * (tn + fn)), 0), 0), 9) as mcc from (select l.lang,
    count(*) filter (quality = 1 and score >= threshold) as tp,
    count(*) filter (quality = 0 and score >= threshold) as fp,
    count(*) filter (quality = 1 and score < threshold) as fn,
    count(*) filter (quality = 0 and score < threshold) as tn
    from labelled l join cut on l.lang = cut.lang group by l.lang)""")
def _(spark, sf):
    rows = labelled(spark, sf)
    cuts = me.youden_cutoff(rows, "score", "quality", 1, ["lang"])
    return rounded(me.mcc_at(rows, "score", "quality", 1, cuts, ["lang"]), "mcc")


@check("mcc_fixed", sql("labelled", """select count(*) filter (quality = 1 and score <= 50) as tp,
    count(*) filter (quality = 0 and score <= 50) as fp,
    count(*) filter (quality = 1 and score > 50) as fn,
    count(*) filter (quality = 0 and score > 50) as tn,
    round(corr(quality, (score <= 50)::int), 9) as mcc from labelled"""))
def _(spark, sf):
    return rounded(me.mcc(labelled(spark, sf), "score", "quality", 1, 50, "le"), "mcc")


@check("top_abs_grouped", sql("labelled", """select doc_id, lang, source, score, quality, toxic from
    (select *, row_number() over (partition by lang order by abs(score) desc, doc_id) as rn
    from labelled) where rn <= 7"""))
def _(spark, sf):
    return me.top_abs(labelled(spark, sf), 7, "score", "doc_id", ["lang"])


TOP = """(select doc_id, score, quality from labelled order by abs(score) desc, doc_id limit {0})
    union all (select doc_id, score, quality from labelled where quality = 0
    order by {1}, doc_id limit {0})"""
DRAW = UNIT.format("doc_id", 42)


@check("top_abs_grouped_many", """select event_id, event_type, value from (select *, row_number() over
    (partition by event_type order by abs(value - 50) desc, event_id) as place from events) where place <= 5000""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value", (F.col("value") - 50).alias("effect"))
    return me.top_abs(rows, 5000, "effect", "event_id", ["event_type"]).drop("effect")


@check("top_abs_with_negatives", sql("labelled", TOP.format(50, DRAW)))
def _(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "score", "quality")
    return me.top_abs_with_negatives(rows, 50, 0, "doc_id", "score", "quality")


AREA = """select {0}, cast(sum(p) as bigint) as positives, cast(sum(n) as bigint) as negatives,
    round(sum(p * (below + n / 2.0::double)) / nullif(cast(sum(p) as double) * sum(n), 0), 9) as auroc
    from (select *, coalesce(sum(n) over (partition by {0} order by s rows between unbounded preceding
    and 1 preceding), 0) as below from (select {0}, abs(score) as s,
    count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as n from tagged
    group by {0}, abs(score))) group by {0}"""


@check("auroc_top_n", sql("labelled", "") + f""", tagged as (select *, 'All' as subset from (select
    doc_id, score, quality from labelled) union all select *, '50' from ({TOP.format(50, DRAW)})
    union all select *, '20' from ({TOP.format(20, DRAW)})) """ + AREA.format("subset"))
def _(spark, sf):
    out = me.auroc_top_n(labelled(spark, sf), 0, 1, "doc_id", (50, 20), "score", "score", "quality")
    return rounded(out, "auroc")


@check("auroc_by_subset", sql("labelled", "") + """, tagged as (
    select toxic, 'all' as level, 'All data' as subset, score, quality from labelled union all
    select toxic, 'named', 'src1', score, quality from labelled where source = 'src1' union all
    select toxic, 'lang', lang, score, quality from labelled union all
    select toxic, 'source', source, score, quality from labelled) """
       + AREA.format("toxic, level, subset"))
def _(spark, sf):
    out = me.auroc_by_subset(labelled(spark, sf), "score", "quality", 1, "toxic", ["lang", "source"],
                             [("source", "src1")])
    return rounded(out, "auroc")


@check("variant_auroc", sql(MATCHED, "") + ", " + LABELS + """, tagged as (
    select region_type, log2FC as score, case when label = 'pos' then 1 when label = 'neg' then 0 end
    as quality from labels_) """ + AREA.format("region_type"))
def _(spark, sf):
    return rounded(me.auroc(labelled_variants(spark, sf), F.abs("log2FC"), "label", "pos",
                            ["region_type"]), "auroc")


BINNED = """r as (select min(value) as lo, max(value) as hi from events),
    b as (select event_type as series, least(cast(floor((value - lo) / (hi - lo) * 50) as int), 49)
    as bin from events, r), c as (select series, bin, count(*) as n from b group by all),
    f as (select series, cast(i as int) as bin, total from (select series, sum(n) as total from c
    group by series), generate_series(0, 49) g(i))"""


@check("histogram", "with " + BINNED + """ select series, bin, round(lo + (hi - lo) / 50 * bin, 6) as bin_lo,
    round(lo + (hi - lo) / 50 * (bin + 1), 6) as bin_hi, coalesce(n, 0) as n,
    round(coalesce(n, 0) / (total * ((hi - lo) / 50)), 9) as height
    from f left join c using (series, bin), r""")
def _(spark, sf):
    out = su.histogram(table(spark, sf, "events"), "value", 50, "event_type", density=True)
    return rounded(rounded(out, "bin_lo", "bin_hi", digits=6), "height")


BOX = """g as (select l_returnflag, count(*) as n, quantile_cont(l_extendedprice, 0.25) as q1,
    median(l_extendedprice) as med, quantile_cont(l_extendedprice, 0.75) as q3,
    quantile_cont(l_extendedprice, 0.025) as lo_p, quantile_cont(l_extendedprice, 0.975) as hi_p
    from lineitem group by l_returnflag)"""
BOX_OUT = """select l_returnflag, any_value(n) as n, round(any_value(q1), 6) as q1,
    round(any_value(med), 6) as med, round(any_value(q3), 6) as q3,
    least(round(any_value(q1), 6), min(l_extendedprice) filter (l_extendedprice >= {0})) as whisker_lo,
    greatest(round(any_value(q3), 6), max(l_extendedprice) filter (l_extendedprice <= {1}))
    as whisker_hi, round(any_value(med - 1.57::double * (q3 - q1) / sqrt(n)), 6) as notch_lo,
    round(any_value(med + 1.57::double * (q3 - q1) / sqrt(n)), 6) as notch_hi,
    count(*) filter (l_extendedprice < {0} or l_extendedprice > {1}) as outliers
    from lineitem join g using (l_returnflag) group by l_returnflag"""
BOX_COLUMNS = ["q1", "med", "q3", "whisker_lo", "whisker_hi", "notch_lo", "notch_hi"]


@check("box_stats", f"with {BOX} {BOX_OUT.format('q1 - 0.5 * (q3 - q1)', 'q3 + 0.5 * (q3 - q1)')}")
def _(spark, sf):
    out = su.box_stats(price_keys(spark, sf), ["l_returnflag"], "l_extendedprice", 0.5)
    return rounded(out, *BOX_COLUMNS, digits=6)


@check("box_stats_percentiles", f"with {BOX} {BOX_OUT.format('lo_p', 'hi_p')}")
def _(spark, sf):
    out = su.box_stats(price_keys(spark, sf), ["l_returnflag"], "l_extendedprice", (2.5, 97.5))
    return rounded(out, *BOX_COLUMNS, digits=6)


@check("box_outliers", f"""with {BOX} select l_returnflag, l_extendedprice, count(*) as n from lineitem
    join g using (l_returnflag) where l_extendedprice < q1 - 0.5 * (q3 - q1)
    or l_extendedprice > q3 + 0.5 * (q3 - q1) group by all""")
def _(spark, sf):
    return su.box_outliers(price_keys(spark, sf), ["l_returnflag"], "l_extendedprice", 0.5)


def value_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value")


@check("sample_rows", f"""select event_id, event_type, value from events
    order by {UNIT.format("event_id", 3)}, event_id limit 500""")
def _(spark, sf):
    return sa.sample_rows(value_rows(spark, sf), 500, "event_id", 3)


@check("sample_many_rows", f"""select o_orderkey, o_totalprice from orders
    order by {UNIT.format("o_orderkey", 5)}, o_orderkey limit 12000""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sa.sample_rows(rows, 12000, "o_orderkey", 5)


@check("top_rows_with_ties", """select o_orderkey, o_totalprice from orders
    order by -floor(o_totalprice / 50000), o_orderkey limit 11000""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", (-F.floor(F.col("o_totalprice") / 50000)).alias("step"))
    return take_first(rows, 11000, ["step", "o_orderkey"]).drop("step")


@check("row_number", """select row_number() over (order by event_id) as index, event_id, event_type,
    value from events""")
def _(spark, sf):
    return sa.with_row_number(value_rows(spark, sf), 1)


@check("thin_class", f"""select event_id, event_type, value from events where event_type = 'error'
    or (event_type = 'click' and {UNIT.format("event_id", 9)} < 0.1)""")
def _(spark, sf):
    return sa.thin_class(value_rows(spark, sf), "event_type", "click", "error", 0.1, "event_id", 9)


@check("weighted_sample", f"""select event_id, event_type, value from events
    order by -ln({UNIT.format("event_id", 11)}) / value, event_id
    limit (select cast(floor(count(*) * 0.05::double) as bigint) from events)""")
def _(spark, sf):
    return sa.weighted_sample(value_rows(spark, sf), "value", 0.05, "event_id", 11)


MASS = """r as (select min(value) as lo, max(value) as hi from events),
    b as (select *, least(floor((value - lo) / (hi - lo) * 100), 99) as bin from events, r),
    m as (select bin, pdf, sum(pdf) over (order by bin) as cdf from (select bin,
    count(*) / (select count(*) from events) as pdf from b group by bin))"""


@check("score_density", f"""with {MASS} select event_id, value, round(pdf, 9) as pdf,
    round(cdf, 9) as cdf from b join m using (bin)""")
def _(spark, sf):
    return rounded(sa.score_density(value_rows(spark, sf).drop("event_type"), "value", 100), "pdf", "cdf")


def cubic(y):
    """Slopes at the bin mids, then the cubic between two of them, of column ``y``."""
    return f"""{y}_d as (select *, (lead({y}) over o - {y}) / step as up from t window o as (order by bin)),
    {y}_n as (select *, lag(up) over o as back, lead(up) over o as up2, lag(up, 2) over o as back2 from {y}_d
    window o as (order by bin)),
    {y}_e as (select *, (3 * up - up2) / 2 as first, (3 * back - back2) / 2 as last from {y}_n),
    {y}_s as (select bin, {y}, case when back is null then
    case when up2 is null then up when sign(first) <> sign(up) then 0
    when sign(up) <> sign(up2) and abs(first) > 3 * abs(up) then 3 * up else first end
    when up is null then case when back2 is null then back when sign(last) <> sign(back) then 0
    when sign(back) <> sign(back2) and abs(last) > 3 * abs(back) then 3 * back else last end
    when back * up <= 0 then 0 else 2 * back * up / (back + up) end as slope from {y}_e),
    {y}_c as (select v.event_id, a.{y} * (1 + u) * (1 + u) * (1 - 2 * u) + a.slope * v.step * (1 + u) * (1 + u) * u as x
    from (select event_id, u - 1 as u, slot + 1 as bin, step from v) v join {y}_s a using (bin) union all
    select v.event_id, a.{y} * (1 - u) * (1 - u) * (1 + 2 * u) + a.slope * v.step * u * (1 - u) * (1 - u)
    from v join {y}_s a on a.bin = v.slot),
    {y}_v as (select event_id, sum(x) as {y} from {y}_c group by event_id)"""


# each end of an interval carries a cubic of its own: with u counted from that end, it is 1 there with
# slope 0, or 0 with slope 1, and 0 at the other end; the value is the sum over both ends
SMOOTH = f"""r as (select min(value) as lo, max(value) as hi, (max(value) - min(value)) / 100 as step from events),
    m as (select bin, count(c) / (select count(*) from events) as pdf from (select unnest(range(100)) as bin)
    left join (select least(floor((value - lo) / (hi - lo) * 100), 99)::bigint as c from events, r) on c = bin group by bin),
    t as (select bin, pdf, sum(pdf) over (order by bin) as cdf, step, lo + (bin + 0.5::double) * step as mid from m, r),
    v as (select event_id, value, step, least(greatest(floor((value - lo) / step - 0.5::double), 0), 98)::bigint as slot,
    (value - lo) / step - 0.5::double - least(greatest(floor((value - lo) / step - 0.5::double), 0), 98) as u
    from events, r), {cubic("pdf")}, {cubic("cdf")}"""


@check("score_density_smooth", f"""with {SMOOTH} select event_id, value, round(pdf, 6) as pdf, round(cdf, 6) as cdf
    from v join pdf_v using (event_id) join cdf_v using (event_id)""")
def _(spark, sf):
    rows = sa.score_density(value_rows(spark, sf).drop("event_type"), "value", 100, interpolate=True)
    return rounded(rows, "pdf", "cdf", digits=6)


ERF = """(sign({0}) * (1 - ((((1.061405429::double * (1 / (1 + 0.3275911::double * abs({0})))
    - 1.453152027::double) * (1 / (1 + 0.3275911::double * abs({0}))) + 1.421413741::double)
    * (1 / (1 + 0.3275911::double * abs({0}))) - 0.284496736::double)
    * (1 / (1 + 0.3275911::double * abs({0}))) + 0.254829592::double)
    * (1 / (1 + 0.3275911::double * abs({0}))) * exp(-({0}) * ({0}))))"""
LOGNORMAL = f"(0.5::double * (1 + {ERF.format('(ln(value / 30.0::double) / sqrt(2))')}))"


@check("acceptance_lognormal", f"""select event_id, round({LOGNORMAL}, 9) as plain,
    round(pow({LOGNORMAL}, 10), 9) as tenth from events""")
def _(spark, sf):
    rows = sa.acceptance(value_rows(spark, sf), "value", "lognormal", scale=30.0, out="plain")
    rows = sa.acceptance(rows, "value", "lognormal", scale=30.0, power=10.0, out="tenth")
    return rounded(rows.select("event_id", "plain", "tenth"), "plain", "tenth")


@check("acceptance_rarity", f"""with {MASS} select event_id, round(1 - pdf, 9) as accept
    from b join m using (bin)""")
def _(spark, sf):
    rows = sa.acceptance(value_rows(spark, sf), "value", "rarity", 100, interpolate=False)
    return rounded(rows.select("event_id", "accept"), "accept")


@check("acceptance_ecdf", f"""with {MASS} select event_id, round(cdf, 9) as accept from b join m using (bin)""")
def _(spark, sf):
    rows = sa.acceptance(value_rows(spark, sf), "value", "ecdf", 100, interpolate=False)
    return rounded(rows.select("event_id", "accept"), "accept")


@check("sample_report", f"""with w as (select 'by value' as method, event_id, event_type, value as w
    from events union all select 'even', event_id, event_type, 1.0::double from events),
    s as (select *, row_number() over (partition by method order by
    -ln({UNIT.format("event_id", 13)}) / w) as rn, count(*) over (partition by method) as n from w)
    select method, frac, count(*) as sampled, count(*) filter (event_type = 'error') as positives,
    count(*) filter (event_type = 'error') / count(*) as share
    from s, (values (0.1::double), (0.05::double), (0.01::double)) f(frac) where rn <= floor(n * frac)
    group by method, frac""")
def _(spark, sf):
    rows = value_rows(spark, sf).withColumn("even", F.lit(1.0))
    return sa.sample_report(rows, F.col("event_type") == "error",
                            {"by value": "value", "even": "even"}, key="event_id", seed=13)
