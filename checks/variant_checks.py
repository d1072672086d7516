"""Measured and predicted variants, labels, coverage of regions."""

from pyspark.sql import functions as F

from checks.recipes import (base, element_preds, mpra, regions, replicates, sql, table, text,
                            variant_preds)
from checks.registry import check
from locuskit.functions import (hash_unit, ln_to_log2, log10_floored, motif_name, region_id, revcomp,
                                row_mean, row_min, single_base)
from locuskit.operators import coverage as co
from locuskit.operators import joins as jo
from locuskit.operators import summaries as su
from locuskit.operators import variants as va
from locuskit.session import scratch_path
from locuskit.sources.tables import materialize_if_absent


def matched(spark, sf, **options):
    return va.join_preds_to_mpra(variant_preds(spark, sf), mpra(spark, sf), **options)


LABELS = """labels_ as (select *, case when mpra_p_value > 0.05 and abs(mpra_max_log2effect) < 0.1
    and mpra_tags >= 10 then 'neg' when mpra_p_value <= 0.1 and mpra_tags >= 10 then 'pos' end
    as label from matched)"""
MATCHED = "mpra variant_preds best matched"


def labelled_variants(spark, sf):
    return va.add_class_labels(matched(spark, sf), 0.1, 0.05, 0.1, "pos", "neg", 10)


@check("single_base", """select l_orderkey, l_linenumber, l_returnflag as ref_allele,
    l_shipmode as alt_allele from (select *, case when l_linenumber = 1 then '-'
    when l_linenumber = 2 then l_linestatus || l_linestatus else l_linestatus end as l_shipmode
    from lineitem) where octet_length(encode(l_shipmode)) = 1 and l_shipmode <> '-'""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    n, s = F.col("l_linenumber"), F.col("l_linestatus")
    rows = li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("ref_allele"),
                     F.when(n == 1, "-").when(n == 2, F.concat(s, s)).otherwise(s).alias("alt_allele"))
    return va.keep_single_base(rows)


@check("max_abs_measurement", sql("mpra best", """select region_type, region, chrom, allele_pos,
    ref_allele, alt_allele, Value as mpra_max_log2effect, p_value as mpra_p_value,
    Tags as mpra_tags, experiment as mpra_experiment from best"""))
def _(spark, sf):
    return va.max_abs_measurement(mpra(spark, sf))


@check("join_preds_to_mpra", sql(MATCHED, "select * from matched"))
def _(spark, sf):
    return matched(spark, sf)


# predictions with several values per variant
MANY = """many as (select chrom, allele_pos, ref_allele, alt_allele, log2FC from variant_preds
    union all select chrom, allele_pos, alt_allele, alt_allele, -2 * log2FC + 1 from variant_preds)"""
MANY_JOIN = """select b.region_type, b.region, b.chrom, b.allele_pos, b.ref_allele,
    p.pred_ref_allele, b.alt_allele, p.log2FC, b.Value as mpra_max_log2effect,
    b.p_value as mpra_p_value, b.Tags as mpra_tags, b.experiment as mpra_experiment
    from best b join reduced p on b.chrom = p.chrom and b.allele_pos = p.allele_pos
    and b.alt_allele = p.alt_allele"""


def many_preds(spark, sf):
    v = variant_preds(spark, sf)
    more = v.select("chrom", "allele_pos", F.col("alt_allele").alias("ref_allele"), "alt_allele",
                    (-2 * F.col("log2FC") + 1).alias("log2FC"))
    return v.unionByName(more)


@check("join_all_pred_rows", sql("mpra variant_preds best", "") + ", " + MANY + """, reduced as (
    select distinct chrom, allele_pos, alt_allele, ref_allele as pred_ref_allele, log2FC from many) """
       + MANY_JOIN)
def _(spark, sf):
    return va.join_preds_to_mpra(many_preds(spark, sf), mpra(spark, sf), keep_pred_rows=True)


@check("join_mean_pred", sql("mpra variant_preds best", "") + ", " + MANY + """, reduced as (
    select chrom, allele_pos, alt_allele, min(ref_allele) as pred_ref_allele,
    round(avg(log2FC), 6) as log2FC from many group by all) """ + MANY_JOIN)
def _(spark, sf):
    out = va.join_preds_to_mpra(many_preds(spark, sf), mpra(spark, sf), agg="mean")
    return out.withColumn("log2FC", F.round("log2FC", 6))


@check("join_max_abs_pred", sql("mpra variant_preds best", "") + ", " + MANY + """, reduced as (
    select * from (select chrom, allele_pos, alt_allele, ref_allele as pred_ref_allele, log2FC,
    row_number() over (partition by chrom, allele_pos, alt_allele order by abs(log2FC) desc,
    ref_allele, log2FC) as rn from many) where rn = 1) """ + MANY_JOIN)
def _(spark, sf):
    return va.join_preds_to_mpra(many_preds(spark, sf), mpra(spark, sf), agg="max_abs")


CALLS = """calls as (select distinct chrom, allele_pos, ref_allele, alt_allele,
    1 + allele_pos % 7 / 7.0::double - 0.4::double as theta,
    1 + allele_pos % 7 / 7.0::double - 0.5::double as "lowerCI",
    1 + allele_pos % 7 / 7.0::double as "upperCI",
    allele_pos % 101 / 101.0::double as "P_reg" from mpra)
    , counts as (select chrom, allele_pos, alt_allele, sum(Tags) / 20.0::double as avg_input_ref,
    min(Tags) / 2.0::double as min_avg_count, max(Tags) / 3.0::double as naive_theta,
    count(*) as reads from mpra group by all)"""


def calls(spark, sf):
    pos = F.col("allele_pos")
    share = pos % 7 / F.lit(7.0)
    return (mpra(spark, sf).select(*va.PLACE, "ref_allele").distinct()
            .withColumns({"theta": 1 + share - 0.4, "lowerCI": 1 + share - 0.5, "upperCI": 1 + share,
                          "P_reg": pos % 101 / F.lit(101.0)}))


def counts(spark, sf):
    return mpra(spark, sf).groupBy(*va.PLACE).agg(
        (F.sum("Tags") / 20.0).alias("avg_input_ref"), (F.min("Tags") / 2.0).alias("min_avg_count"),
        (F.max("Tags") / 3.0).alias("naive_theta"), F.count(F.lit(1)).alias("reads"))


def called(spark, sf):
    p = variant_preds(spark, sf).withColumnRenamed("alt_allele", "allele")
    return va.calls_preds_counts(calls(spark, sf), p, counts(spark, sf))


CALLED = sql("mpra variant_preds", "") + ", " + CALLS + """, called as (select c.*,
    p.ref_allele as pred_ref_allele, p.log2FC, n.avg_input_ref, n.min_avg_count from calls c
    join variant_preds p using (chrom, allele_pos, alt_allele)
    join counts n using (chrom, allele_pos, alt_allele)) """
CALLED = CALLED.replace("c.*,\n    p.ref_allele", """c.chrom, c.allele_pos, c.ref_allele,
    c.alt_allele, c.theta, c."lowerCI", c."upperCI", c."P_reg", p.ref_allele""")
REPORT = """select chrom, allele_pos as pos, ref_allele as ref, alt_allele as alt,
    log2FC as "pred_log2FC", round(log2(theta), 9) as log2_theta,
    round(log2(naive_theta), 9) as log2_naive_theta, "P_reg", reads from called join (select chrom,
    allele_pos, alt_allele, naive_theta, reads, min_avg_count as m from counts) n
    using (chrom, allele_pos, alt_allele) where ("P_reg" > 0.3 or ("P_reg" <= 0.3
    and avg_input_ref >= 3)) and m >= 1"""


@check("calls_preds_counts", CALLED + "select * from called")
def _(spark, sf):
    return called(spark, sf)


def report(spark, sf):
    return va.theta_report(called(spark, sf), counts(spark, sf), ["reads"], 0.3, 3, 1)


def rounded(df, *names, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in names})


@check("theta_report", CALLED + REPORT)
def _(spark, sf):
    return rounded(report(spark, sf), "log2_theta", "log2_naive_theta")


@check("report_tails", CALLED + f"""select 'up' as tail, * from ({REPORT}) where "P_reg" > 0.99
    union all select 'none', * from ({REPORT}) where "P_reg" < 0.1""")
def _(spark, sf):
    r = report(spark, sf)
    both = jo.tagged_union({"up": va.report_tail(r, above=0.99), "none": va.report_tail(r, below=0.1)},
                           "tail")
    return rounded(both, "log2_theta", "log2_naive_theta")


@check("posterior_labels", sql("mpra", "") + ", " + CALLS + """ select chrom, allele_pos, alt_allele,
    case when "P_reg" <= 0.3 then 'P_reg ≤ 0.3' when "P_reg" >= 0.9 then 'P_reg ≥ 0.9' end as label,
    case when theta > 1 then 'up' when theta < 1 then 'down' end as direction from calls""")
def _(spark, sf):
    out = va.add_direction(va.add_posterior_labels(calls(spark, sf)), "theta", 1.0, "theta", False)
    return out.select(*va.PLACE, "label", "direction")


@check("class_subset", sql("mpra", "") + ", " + CALLS + """ select chrom, allele_pos, alt_allele,
    avg_input_ref from calls join counts using (chrom, allele_pos, alt_allele)
    where ("P_reg" <= 0.3 and avg_input_ref >= 10) or "P_reg" >= 0.9""")
def _(spark, sf):
    rows = va.add_posterior_labels(calls(spark, sf), pos_label="pos", neg_label="neg")
    joined = rows.join(counts(spark, sf).select(*va.PLACE, "avg_input_ref"), va.PLACE)
    return va.class_subset(joined, 10, "neg", "pos").select(*va.PLACE, "avg_input_ref")


@check("infill", sql("mpra variant_preds best matched", """select 'a' as src, chrom, allele_pos,
    alt_allele from matched union all select 'b', chrom, allele_pos, alt_allele from variant_preds v
    where not exists (select 1 from matched m where m.chrom = v.chrom
    and m.allele_pos = v.allele_pos and m.alt_allele = v.alt_allele)"""))
def _(spark, sf):
    a = matched(spark, sf).select(F.lit("a").alias("src"), *va.PLACE)
    b = variant_preds(spark, sf).select(F.lit("b").alias("src"), *va.PLACE)
    return jo.infill(a, b, va.PLACE)


@check("class_labels", sql(MATCHED, "") + ", " + LABELS + " select * from labels_")
def _(spark, sf):
    return labelled_variants(spark, sf)


@check("effect_direction", sql(MATCHED, "") + ", " + LABELS + """ select chrom, allele_pos, alt_allele,
    label, case when mpra_max_log2effect >= 0 then 'up' else 'down' end as direction,
    abs(log2FC) as "abs_log2FC" from labels_ where label is not null""")
def _(spark, sf):
    rows = va.add_direction(labelled_variants(spark, sf).dropna(subset=["label"]))
    return rows.select(*va.PLACE, "label", "direction", "abs_log2FC")


@check("ref_mismatches", sql(MATCHED, """select * from matched where ref_allele <> pred_ref_allele"""))
def _(spark, sf):
    return va.ref_mismatches(matched(spark, sf))


@check("mismatch_positions", sql(MATCHED, """select region_type, region,
    count(distinct allele_pos) as num_mismatches, count(distinct allele_pos) > 5 as many from matched
    where ref_allele <> pred_ref_allele group by all"""))
def _(spark, sf):
    return va.mismatch_positions(matched(spark, sf))


@check("without_mismatches", sql(MATCHED, """select region, count(*) as n from matched
    where ref_allele = pred_ref_allele and region <> 'R7' group by region"""))
def _(spark, sf):
    kept = va.exclude(va.drop_mismatches(matched(spark, sf)), region="R7")
    return kept.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


ALLELES = """alleles as (select 'chr' || (l_orderkey % 5) as cre_chrom,
    l_orderkey * 100 as cre_start, l_orderkey * 100 + 4 + l_orderkey % 4 as cre_end,
    case when l_orderkey % 50 = 0 then 'chr9' else 'chr' || (l_orderkey % 5) end as bin_chrom,
    l_orderkey * 100 - 1 + l_orderkey % 3 as bin_start, l_orderkey * 100 + 5 as bin_end,
    l_orderkey * 100 + l_linenumber as allele_pos,
    substr('ACGT', (l_orderkey + l_linenumber) % 4 + 1, 1) as ref_allele,
    substr('ACGT', l_suppkey % 4 + 1, 1) as allele, l_tax - l_discount as log2FC from lineitem)"""


def alleles(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    chrom = F.concat(F.lit("chr"), text(k % 5))
    return table(spark, sf, "lineitem").select(
        chrom.alias("cre_chrom"), (k * 100).alias("cre_start"), (k * 100 + 4 + k % 4).alias("cre_end"),
        F.when(k % 50 == 0, "chr9").otherwise(chrom).alias("bin_chrom"),
        (k * 100 - 1 + k % 3).alias("bin_start"), (k * 100 + 5).alias("bin_end"),
        (k * 100 + n).alias("allele_pos"), base(k + n).alias("ref_allele"),
        base(F.col("l_suppkey")).alias("allele"), (F.col("l_tax") - F.col("l_discount")).alias("log2FC"))


RELATIVE = """select *, log2FC - max(case when allele = ref_allele then log2FC end) over (
    partition by cre_chrom, cre_start, cre_end, bin_chrom, bin_start, bin_end, allele_pos)
    as "FC_to_ref" from alleles"""


@check("relative_effect", f"with {ALLELES} {RELATIVE}")
def _(spark, sf):
    return va.relative_to_reference(alleles(spark, sf))


@check("strong_elements", f"""with {ALLELES} select distinct cre_chrom, cre_start from ({RELATIVE})
    where "FC_to_ref" > 0.05""")
def _(spark, sf):
    return su.strong_elements(va.relative_to_reference(alleles(spark, sf)), 0.05)


@check("allele_profile", f"""with {ALLELES} select * from alleles where cre_chrom = 'chr2'
    and cre_start = 700 and allele <> ref_allele""")
def _(spark, sf):
    return va.allele_profile(alleles(spark, sf), "chr2", 700, False)


@check("check_predictions", f"""with {ALLELES}
    select 'one_bin_per_element' as rule, cre_chrom as chrom, cre_start as start, cre_end as "end",
    count(distinct bin_start) as detail from alleles group by all having count(distinct bin_start) > 1
    union all select 'position_inside_bin', cre_chrom, cre_start, cre_end, allele_pos from alleles
    where allele_pos < bin_start or allele_pos >= bin_end
    union all select 'all_positions_of_element', cre_chrom, cre_start, cre_end,
    count(distinct allele_pos) from alleles where cre_end - cre_start < bin_end - bin_start
    group by all having count(distinct allele_pos) <> cre_end - cre_start
    union all select 'all_positions_of_bin', bin_chrom, bin_start, bin_end,
    count(distinct allele_pos) from alleles where cre_end - cre_start >= bin_end - bin_start
    group by all having count(distinct allele_pos) <> bin_end - bin_start
    union all select 'four_alleles', bin_chrom, allele_pos, allele_pos, count(distinct allele)
    from alleles group by bin_chrom, allele_pos having count(distinct allele) <> 4
    union all select 'bin_overlaps_element', cre_chrom, cre_start, cre_end, bin_start from alleles
    where bin_chrom <> cre_chrom or bin_start >= cre_end or bin_end <= cre_start
    union all select 'same_centre', cre_chrom, cre_start, cre_end,
    cast(floor(bin_start / 2 + bin_end / 2) - floor(cre_start / 2 + cre_end / 2) as bigint)
    from alleles where floor(bin_start / 2 + bin_end / 2) <> floor(cre_start / 2 + cre_end / 2)""")
def _(spark, sf):
    return va.check_predictions(alleles(spark, sf))


@check("mismatch_counts", sql(MATCHED, """select region_type, count(*) as total, count(pred_ref_allele) as compared,
    count(*) filter (ref_allele <> pred_ref_allele) as mismatches from matched group by region_type"""))
def _(spark, sf):
    return va.mismatch_counts(matched(spark, sf), ["region_type"])


@check("effect_ratio", """select l_orderkey, l_linenumber, l_partkey,
    round((input_rep1 + input_rep2) / 2, 6) as avg_input_ref,
    round(least((input_rep1 + input_rep2) / 2, input_rep2, ob, oc), 6) as min_avg_count,
    round((oc / nullif(ob, 0)) / nullif(input_rep2 / nullif((input_rep1 + input_rep2) / 2, 0), 0), 6)
    as naive_theta from (select *, case when output_rep1 is null then output_rep2 else
    (output_rep1 + output_rep2) / 2 end as ob, output_rep3 as oc from (select l_orderkey,
    l_linenumber, l_partkey, l_quantity as input_rep1, floor(l_extendedprice / 1000) as input_rep2,
    case when l_discount > 0 then l_discount * 100 end as output_rep1, l_tax * 100 as output_rep2,
    floor(l_extendedprice % 97) as output_rep3 from lineitem))""")
def _(spark, sf):
    groups = {"input_ref": ["input_rep1", "input_rep2"], "input_alt": ["input_rep2"],
              "output_ref": ["output_rep1", "output_rep2"], "output_alt": ["output_rep3"]}
    out = va.count_averages(replicates(spark, sf), groups)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "avg_input_ref",
                              "min_avg_count", "naive_theta"),
                   "avg_input_ref", "min_avg_count", "naive_theta", digits=6)


@check("with_coordinates", """select 'chr' || (o_orderkey % 5) as chrom, case when o_orderkey % 2 = 0
    then 'Enhancers' else 'Promoters' end as region_type, 'R' || o_orderkey as region,
    o_orderkey * 100 + l_linenumber as allele_pos, 'A' as ref_allele, 'C' as alt_allele,
    l_tax as log2FC, l_returnflag as cell_line, l_linestatus as experiment from orders
    join lineitem on o_orderkey = l_orderkey""")
def _(spark, sf):
    rel = table(spark, sf, "lineitem").select(
        F.concat(F.lit("R"), text("l_orderkey")).alias("region"), F.lit("x").alias("region_type"),
        F.col("l_linenumber").cast("bigint").alias("rel_pos"), F.lit("A").alias("ref_allele"),
        F.lit("C").alias("alt_allele"), F.col("l_tax").alias("log2fc"),
        F.col("l_returnflag").alias("cell_line"), F.col("l_linestatus").alias("experiment"))
    return va.with_coordinates(regions(spark, sf), rel)


def coverage(spark, sf):
    return co.region_coverage(regions(spark, sf), element_preds(spark, sf))


COVER = "regions element_preds coverage"
# every position of a matched region next to the predicted positions before and behind it
PLACES = """spots as (select distinct chrom, allele_pos from element_preds),
    places as (select region_type, region, chrom, start_pos, end_pos,
    unnest(generate_series(start_pos, end_pos)) as p from regions r where exists (select 1 from spots s
    where s.chrom = r.chrom and s.allele_pos // 100 * 100 = r.start_pos and s.allele_pos <= r.end_pos))"""
BEFORE = """select region_type, region, format('{}:{}-{}', chrom, min(p), max(p) + 1) as region_id,
    count(*) as region_length from (select places.*, allele_pos from places asof left join spots
    on spots.chrom = places.chrom and spots.allele_pos <= places.p)
    where allele_pos is null or allele_pos < start_pos group by region_type, region, chrom"""
AFTER = """select region_type, region, format('{{}}:{{}}-{{}}', chrom, min(p) - {0}, max(p) + 1) as region_id,
    count(*) + {0} as region_length from (select places.*, allele_pos from places asof left join spots
    on spots.chrom = places.chrom and spots.allele_pos >= places.p)
    where allele_pos is null or allele_pos > end_pos group by region_type, region, chrom"""
BETWEEN = """select region_type, region, format('{}:{}-{}', chrom, reach + 1, following) as region_id,
    following - reach - 1 as region_length from (select region_type, region, chrom,
    max(max(pred_end)) over along as reach, lead(pred_start) over along as following from coverage
    where cre_start is not null group by region_type, region, chrom, pred_start
    window along as (partition by region_type, region, chrom order by pred_start))
    where following > reach + 1"""
NEIGHBOURS = """select x.region_type, x.region, format('{}:{}-{}', x.chrom, x.pred_end + 1, following)
    as region_id, following - x.pred_end - 1 as region_length from coverage x join
    (select region, unnest(starts[:-2]) as pred_start, unnest(starts[2:]) as following
    from (select region, list_sort(list(distinct pred_start)) as starts from coverage
    where cre_start is not null group by region)) using (region, pred_start)
    join coverage y on y.region = x.region and y.pred_start = following"""


@check("region_coverage", sql(COVER, "select * from coverage"))
def _(spark, sf):
    return coverage(spark, sf)


@check("matching_regions", sql("regions element_preds", """select region_type, region,
    format('{}:{}-{}', chrom, start_pos, end_pos + 1) as region_id, 80::bigint as region_length,
    count(distinct cre_start) as total_cres, sum(n)::bigint as total_pred_pos,
    round(sum(round(n * 100 / 80.0::double, 1)), 3) as total_region_cov from (
    select region_type, region, chrom, start_pos, end_pos, cre_start, cre_end, count(*) as n from (
    select *, unnest(generate_series(lo, hi)) as p from (select r.*, cre_start, cre_end,
    min(allele_pos) as lo, max(allele_pos) as hi from regions r join element_preds e on e.chrom = r.chrom
    and e.allele_pos // 100 * 100 = r.start_pos and e.allele_pos <= r.end_pos group by all))
    group by all) group by all"""))
def _(spark, sf):
    return co.matching_regions(coverage(spark, sf))


@check("unmatched_regions", sql("regions element_preds", """select region_type, region,
    format('{}:{}-{}', chrom, start_pos, end_pos + 1) as region_id, 80::bigint as region_length
    from regions anti join (select chrom, allele_pos - allele_pos % 100 as start_pos
    from element_preds where allele_pos % 100 < 80) using (chrom, start_pos)"""))
def _(spark, sf):
    return co.unmatched_regions(coverage(spark, sf))


@check("gap_before", sql("regions element_preds", "").rstrip() + ", " + PLACES + BEFORE)
def _(spark, sf):
    return co.gap_before(coverage(spark, sf))


@check("gap_after", sql("regions element_preds", "").rstrip() + ", " + PLACES + AFTER.format(0))
def _(spark, sf):
    return co.gap_after(coverage(spark, sf))


@check("gap_after_compat", sql("regions element_preds", "").rstrip() + ", " + PLACES + AFTER.format(1))
def _(spark, sf):
    return co.gap_after(coverage(spark, sf), compat=True)


@check("gaps_between", sql(COVER, BETWEEN))
def _(spark, sf):
    return co.gaps_between(coverage(spark, sf))


@check("gaps_between_compat", sql(COVER, NEIGHBOURS))
def _(spark, sf):
    return co.gaps_between(coverage(spark, sf), compat=True)


@check("missing_parts", sql(COVER, "").rstrip() + ", " + PLACES + f"""select * from ({BEFORE}) union all
    select * from ({AFTER.format(0)}) union all
    {BETWEEN}""")
def _(spark, sf):
    return co.missing_parts(coverage(spark, sf))


@check("mpra_regions", sql("mpra", """select region_type, region, chrom,
    min(allele_pos) as start_pos, max(allele_pos) as end_pos,
    max(allele_pos) - min(allele_pos) + 1 as region_length,
    string_agg(distinct experiment, ',' order by experiment) as experiments from mpra
    group by region_type, region, chrom"""))
def _(spark, sf):
    return su.mpra_regions(mpra(spark, sf))


@check("provenance_summary", sql("mpra", """select experiment, count(distinct region_type)
    as num_values, string_agg(distinct region_type, ',' order by region_type) as names
    from mpra group by experiment"""))
def _(spark, sf):
    return su.provenance_summary(mpra(spark, sf), "experiment", "region_type")


@check("class_counts", sql(MATCHED, "") + ", " + LABELS + """ select region_type, region, label,
    grouping(region_type, label, region) as level, count(*) as rows from labels_
    group by grouping sets ((region_type, label), (region, label), (label))""")
def _(spark, sf):
    return su.class_counts(labelled_variants(spark, sf),
                           [["region_type", "label"], ["region", "label"], ["label"]]
                           ).select("region_type", "region", "label", "level", "rows")


@check("table_counts", sql("mpra", """select cast(sum(n) as bigint) as total_rows,
    count(*) as distinct_keys, count(*) filter (n > 1) as repeated_keys,
    count(*) filter (n > 1) / count(*) as repeated_share from (select count(*) as n from mpra
    group by chrom, allele_pos, alt_allele)"""))
def _(spark, sf):
    return su.table_counts(mpra(spark, sf), va.PLACE)


@check("matched_share", sql(MATCHED, """select count(*) as matched, (select count(distinct (chrom,
    allele_pos, alt_allele)) from mpra) as universe, count(*) / (select count(distinct (chrom,
    allele_pos, alt_allele)) from mpra) as share from matched"""))
def _(spark, sf):
    return su.matched_share(matched(spark, sf), mpra(spark, sf), va.PLACE)


@check("scalar_functions", """select l_orderkey, l_linenumber,
    regexp_extract(l_returnflag || case when l_linenumber > 2 then '.' || l_linestatus else '' end,
    '\\.([^\\.]+)$', 1) as name, concat('chr1', ':', l_partkey, '-', l_partkey + 1) as id,
    round(log10(l_discount + 1e-20::double), 9) as log_p, round(l_tax / ln(2), 9) as log2v,
    round((l_quantity + coalesce(l_tax, 0)) / 2, 9) as mean, least(l_quantity, l_tax) as low,
    octet_length(encode(l_returnflag)) = 1 as single, length(l_returnflag) as len from lineitem""")
def _(spark, sf):
    n = F.col("l_linenumber")
    alt = F.concat("l_returnflag", F.when(n > 2, F.concat(F.lit("."), "l_linestatus")).otherwise(""))
    q = [F.col("l_quantity"), F.col("l_tax")]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", motif_name(alt).alias("name"),
        region_id(F.lit("chr1"), F.col("l_partkey"), F.col("l_partkey")).alias("id"),
        F.round(log10_floored(F.col("l_discount")), 9).alias("log_p"),
        F.round(ln_to_log2(F.col("l_tax")), 9).alias("log2v"), F.round(row_mean(q), 9).alias("mean"),
        row_min(q).alias("low"), single_base(F.col("l_returnflag")).alias("single"),
        F.length("l_returnflag").cast("bigint").alias("len"))


@check("revcomp", """select p_partkey, reverse(translate(p_name, 'ACGTacgt', 'TGCAtgca')) as rc,
    (cast(('0x' || substr(md5(p_partkey || '|7'), 1, 13)) as bigint) + 0.5::double)
    / 4503599627370496.0::double as u from part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", revcomp(F.col("p_name")).alias("rc"),
        hash_unit(F.col("p_partkey"), seed=7).alias("u"))
