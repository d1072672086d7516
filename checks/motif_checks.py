"""Interval joins and motif summaries."""

from pyspark.sql import functions as F

from checks.recipes import bins, features, preds, sql, table
from checks.registry import check
from locuskit.operators import intervals as iv
from locuskit.operators import motifs as mo
from locuskit.operators.joins import (add_split_flags, join_by_index, partitioned_join, semi_by_list,
                                      skew_join, split_sizes, tagged_union)
from locuskit.session import scratch_path
from locuskit.sources import colocated as cl


def hits(spark, sf):
    return iv.contained_join(bins(spark, sf), features(spark, sf), ["log2FC", "train", "test"])


def mut_hits(spark, sf):
    return iv.padded_point_join(features(spark, sf), preds(spark, sf))


def pairs(spark, sf):
    return iv.within_distance_join(features(spark, sf), 100)


@check("interval_contained", sql("features bins hits", "select * from hits"))
def _(spark, sf):
    return hits(spark, sf)


@check("interval_within_distance", sql("features pairs", "select * from pairs"))
def _(spark, sf):
    return pairs(spark, sf)


@check("interval_padded_point", sql("features preds mut_hits", "select * from mut_hits"))
def _(spark, sf):
    return mut_hits(spark, sf)


@check("partitioned_join", sql("features bins", """select d.chrom, d.start as seq_start, m.start
    as mot_start, m.pvalue from bins d join features m on d.chrom = m.chrom
    where d.start = m.start and m.pvalue < 0.5"""))
def _(spark, sf):
    condition = (F.col("l.start") == F.col("r.start")) & (F.col("r.pvalue") < 0.5)
    return partitioned_join(bins(spark, sf), features(spark, sf), "chrom", condition,
                            [F.col("l.chrom"), F.col("l.start").alias("seq_start"),
                             F.col("r.start").alias("mot_start"), F.col("r.pvalue")])


@check("track_slice", """select event_type as chrom, event_id as start, event_id + 1 as "end",
    value from events where event_type = 'click' and event_id >= 100 and event_id + 1 <= 5000""")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("chrom"), F.col("event_id").alias("start"),
        (F.col("event_id") + 1).alias("end"), "value")
    return iv.in_interval(e, "click", 100, 5000)


@check("motif_match_counts", sql("features", """select motif_id, motif_name,
    count(*) as num_matches from features group by motif_id, motif_alt_id, motif_name"""))
def _(spark, sf):
    return mo.motif_match_counts(features(spark, sf))


@check("significant_matches", sql("features", """select chrom, start, stop, motif_id, pvalue
    from features where pvalue < 0.0001"""))
def _(spark, sf):
    return mo.significant(features(spark, sf), 1e-4).select("chrom", "start", "stop", "motif_id",
                                                           "pvalue")


@check("pair_stats", sql("features pairs", """select motif_id, motif_name, motif2_name, n as numpairs,
    max(motif_distance) filter (i = 1) as min_distance, max(motif_distance) filter (i = n) as max_distance,
    avg(motif_distance) filter (2 * i between n and n + 2) as median_distance,
    round(sum(motif_distance) / n, 1) as avg_distance from (select *, row_number() over (partition by
    motif_id, motif_name, motif2_name order by motif_distance) as i, count(*) over (partition by motif_id,
    motif_name, motif2_name) as n from pairs) where n > 1 group by motif_id, motif_name, motif2_name, n"""))
def _(spark, sf):
    return mo.pair_stats(pairs(spark, sf))


@check("pairs_without_self", sql("features pairs", """select motif_distance, count(*) as n
    from pairs where not (motif_id = 'MA7' and motif2_id = 'MA7') group by all"""))
def _(spark, sf):
    from locuskit.operators.variants import exclude
    kept = exclude(pairs(spark, sf), motif_id="MA7", motif2_id="MA7")
    return kept.groupBy("motif_distance").agg(F.count(F.lit(1)).alias("n"))


HIT_STATS = """select motif_id, motif_alt_id, motif_name, n as num_hits, count(*) filter (train)
    as train_hits, count(*) filter (test) as test_hits,
    round(avg(log2FC) filter (2 * i between n and n + 2), 6) as median_log2FC,
    max(log2FC) filter (i = ceil(0.75 * n)) as q75_log2FC, max(log2FC) filter (i = ceil(0.95 * n)) as q95_log2FC
    from (select *, row_number() over (partition by motif_id, motif_alt_id, motif_name order by log2FC) as i,
    count(*) over (partition by motif_id, motif_alt_id, motif_name) as n from hits)
    group by motif_id, motif_alt_id, motif_name, n"""


@check("hit_stats", sql("features bins hits", HIT_STATS))
def hit_stats(spark, sf):
    return mo.hit_stats(hits(spark, sf)).withColumn("median_log2FC", F.round("median_log2FC", 6))


@check("active_motifs", sql("features bins hits", f"""select motif_name,
    max(median_log2FC) as median_log2FC from ({HIT_STATS}) where median_log2FC >= 0.1
    and num_hits >= 9 group by motif_name"""))
def _(spark, sf):
    return mo.active_set(hit_stats(spark, sf), "motif_name", 0.1, 9, "num_hits")


@check("active_motif_hits", sql("features bins hits", f"""select h.* from hits h
    where motif_id in (select motif_id from ({HIT_STATS}) where median_log2FC >= 0)"""))
def _(spark, sf):
    active = hit_stats(spark, sf).filter(F.col("median_log2FC") >= 0)
    h = hits(spark, sf)
    joined = skew_join(h, active.select("motif_id").distinct(), ["motif_id"])
    return joined.select(*[F.col(f"l.{c}") for c in h.columns])


@check("pairs_with_active", sql("features pairs", """select chrom, start, motif_id, motif2_id,
    motif_distance from pairs where motif_id in (select motif_id from features where pvalue < 0.001)
    or motif2_id in (select motif_id from features where pvalue < 0.001)"""))
def _(spark, sf):
    active = mo.significant(features(spark, sf), 0.001)
    found = semi_by_list(pairs(spark, sf), ["motif_id", "motif2_id"], active, "motif_id")
    return found.select("chrom", "start", "motif_id", "motif2_id", "motif_distance")


@check("dedup_median", sql("features bins hits", """select motif_name,
    round(median(log2FC), 6) as median_log2FC from (select distinct chrom, seq_start, log2FC,
    motif_name from hits) group by motif_name"""))
def _(spark, sf):
    return mo.dedup_median(hits(spark, sf)).withColumn("median_log2FC", F.round("median_log2FC", 6))


def combos(spark, sf):
    return mo.combination_hits(hits(spark, sf))


@check("combination_hits", sql("features bins hits combos", "select * from combos"))
def _(spark, sf):
    return combos(spark, sf)


COMBO = """round(median(log2FC), 6) as median_log2FC, quantile_disc(log2FC, 0.75) as q75_log2FC,
    quantile_disc(log2FC, 0.95) as q95_log2FC, min(num_hits) as num_motifs,
    min(num_tfs) as num_tfs"""
# pairs of motifs instead of whole bins, so that combinations recur
PAIRED = """paired as (select chrom, start as seq_start, 2 as num_hits, 2 as num_tfs,
    least(motif_name, motif2_name) || ', ' || greatest(motif_name, motif2_name) as motif_names,
    motif_distance as max_motif_dist, start % 7 / 7.0::double as log2FC, start % 2 = 0 as train,
    start % 5 = 0 as test, start % 3 as dataset from pairs)"""


def paired(spark, sf):
    p = pairs(spark, sf)
    a, b = F.col("motif_name"), F.col("motif2_name")
    name = F.concat(F.least(a, b), F.lit(", "), F.greatest(a, b))
    return p.select(
        "chrom", F.col("start").alias("seq_start"), F.lit(2).alias("num_hits"),
        F.lit(2).alias("num_tfs"), name.alias("motif_names"), name.alias("motif_names_o"),
        F.col("motif_distance").alias("max_motif_dist"),
        (F.col("start") % 7 / F.lit(7.0)).alias("log2FC"), (F.col("start") % 2 == 0).alias("train"),
        (F.col("start") % 5 == 0).alias("test"), (F.col("start") % 3).alias("dataset"))


@check("combination_stats", sql("features pairs", "").rstrip() + ", " + PAIRED + f"""
    select dataset, motif_names, count(*) as num_seqs, count(*) filter (train) as train_seqs,
    count(*) filter (test) as test_seqs, {COMBO} from paired group by dataset, motif_names""")
def _(spark, sf):
    stats = mo.combination_stats(paired(spark, sf), ["dataset"])
    return stats.withColumn("median_log2FC", F.round("median_log2FC", 6))


@check("combination_ranking", sql("features pairs", "").rstrip() + ", " + PAIRED + """
    select motif_names, count(*) as num_seqs, round(median(log2FC), 6) as median_log2FC
    from paired group by motif_names order by 3 desc, 2 desc, 1 limit 25""")
def _(spark, sf):
    stats = mo.combination_stats(paired(spark, sf))
    return (stats.select("motif_names", "num_seqs", F.round("median_log2FC", 6).alias("median_log2FC"))
            .orderBy(F.desc("median_log2FC"), F.desc("num_seqs"), "motif_names").limit(25))


@check("active_combinations", sql("features pairs", "").rstrip() + ", " + PAIRED + """
    select motif_names, max(m) as median_log2FC from (select dataset, motif_names, count(*) as n,
    round(median(log2FC), 6) as m from paired group by all) where m >= 0.3 and n >= 5
    group by motif_names""")
def _(spark, sf):
    stats = mo.combination_stats(paired(spark, sf), ["dataset"]).withColumn(
        "median_log2FC", F.round("median_log2FC", 6))
    return mo.active_set(stats, "motif_names", 0.3, 5, max_motifs=3)


@check("combination_distance_stats", sql("features pairs", "").rstrip() + ", " + PAIRED + """
    select motif_names, max_motif_dist, count(*) as num_seqs, count(*) filter (train) as in_train,
    count(*) filter (test) as in_test, round(median(log2FC), 6) as median_log2FC from paired
    group by all having count(*) > 3""")
def _(spark, sf):
    stats = mo.combination_distance_stats(paired(spark, sf), 3)
    return stats.withColumn("median_log2FC", F.round("median_log2FC", 6))


@check("distance_bins", sql("features pairs", """select motif_distance,
    cast(motif_distance // 10 * 10 + 5 as double) as dist_category,
    motif_distance // 20 * 20 + 10 as dist_whole from pairs"""))
def _(spark, sf):
    p = pairs(spark, sf).select("motif_distance")
    narrow = mo.distance_bins(p, 10, "motif_distance").withColumnRenamed("dist_category", "narrow")
    return (mo.distance_bins(narrow, 20, "motif_distance", whole=True)
            .select("motif_distance", F.col("narrow").alias("dist_category"),
                    F.col("dist_category").alias("dist_whole")))


@check("motif_mutation_stats", sql("features preds mut_hits", """select motif_id,
    min(motif_name) as motif_name, count(distinct chrom) as num_chroms,
    count(distinct mot_start) as num_motif_hits, count(*) as num_mut, min(log2FC) as min_log2FC,
    max(log2FC) as max_log2FC, max(abs(log2FC)) as max_abs_log2FC from mut_hits group by motif_id"""))
def _(spark, sf):
    return mo.motif_mutation_stats(mut_hits(spark, sf))


@check("ambiguous_motif_names", sql("features preds mut_hits", """select motif_name,
    string_agg(distinct motif_id, ',' order by motif_id) as motif_ids,
    count(distinct motif_id) as num_ids, min(mot_end - mot_start + 1) as motif_len_min,
    max(mot_end - mot_start + 1) as motif_len_max from mut_hits group by motif_name
    having count(distinct motif_id) > 1"""))
def _(spark, sf):
    return mo.ambiguous_motif_names(mut_hits(spark, sf))


@check("position_effects", sql("features preds mut_hits", """select motif_id, motif_name, chrom,
    mot_start, mot_end, allele_pos - mot_start as motif_pos, ref_allele, alt_allele, log2FC from
    (select *, row_number() over (partition by motif_id, motif_name, chrom, mot_start, mot_end,
    allele_pos, ref_allele order by abs(log2FC) desc, alt_allele desc, log2FC desc) as rn
    from mut_hits) where rn = 1 and motif_id in (select motif_id from mut_hits group by motif_id
    having max(abs(log2FC)) >= 2.5 and count(distinct mot_start) >= 9)"""))
def _(spark, sf):
    return mo.position_effects(mut_hits(spark, sf), 2.5, 9)


@check("join_by_index", sql("bins", """select chrom, start, "end", t as "true", value as predicted
    from (select event_id * 128 + ascii(event_type) as index, event_id / 100.0::double as t, value from events) p
    join (select *, start * 128 + ascii(chrom) as index from bins) b using (index)"""))
def _(spark, sf):
    number = lambda at, chrom: F.col(at) * 128 + F.ascii(chrom)
    b = bins(spark, sf).withColumn("index", number("start", "chrom"))
    p = table(spark, sf, "events").select(
        number("event_id", "event_type").alias("index"), (F.col("event_id") / F.lit(100.0)).alias("true"),
        F.col("value").alias("predicted"))
    return join_by_index(p, b)


@check("split_flags", """select o_orderkey as index, o_orderstatus as chrom, o_orderkey as start,
    o_orderkey + 1 as "end", o_orderkey in (select l_orderkey from lineitem where l_quantity > 40)
    as train, o_orderkey in (select l_orderkey from lineitem where l_quantity < 5) as test
    from orders""")
def split_flags(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    b = o.select(k.alias("index"), F.col("o_orderstatus").alias("chrom"), k.alias("start"),
                 (k + 1).alias("end"))
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "index")
    ids = lambda test: b.join(li.filter(test).select("index").distinct(), "index")
    return add_split_flags(b, {"train": ids(F.col("l_quantity") > 40),
                               "test": ids(F.col("l_quantity") < 5)})


@check("split_sizes", """select split, size, size / n as fraction from (select count(*) as n,
    count(*) filter (o_orderkey in (select l_orderkey from lineitem where l_quantity > 40)) as a,
    count(*) filter (o_orderkey in (select l_orderkey from lineitem where l_quantity < 5)) as b
    from orders), lateral (values ('train', a), ('test', b)) t(split, size)""")
def _(spark, sf):
    return split_sizes(split_flags(spark, sf), ["train", "test"])


@check("tagged_union", sql("features", """select 'low' as dataset, motif_id, start from features
    where pvalue < 0.5 union all select 'high', motif_id, start from features
    where pvalue >= 0.5"""))
def _(spark, sf):
    f = features(spark, sf).select("motif_id", "start", "pvalue")
    parts = {"low": f.filter("pvalue < 0.5"), "high": f.filter("pvalue >= 0.5")}
    return tagged_union({k: d.drop("pvalue") for k, d in parts.items()}, "dataset")


def mixed_spans(spark, sf):
    """Intervals of ten bases to ten megabases: one per event."""
    e = table(spark, sf, "events")
    length = F.element_at(F.array(*[F.lit(10 ** i).cast("bigint") for i in range(1, 8)]),
                          (F.col("user_id") % 7 + 1).cast("int"))
    start = F.col("event_id") * 100
    return e.select(F.col("event_type").alias("chrom"), "event_id", start.alias("lo"), (start + length).alias("hi"))


MIXED = """spans as (select event_type as chrom, event_id, event_id * 100 as lo,
    event_id * 100 + (10 ** (user_id % 7 + 1))::bigint as hi from events),
    marks as (select event_type as chrom, event_id * 9973 % 1000003 * 10 as place from events where event_id % 97 < 3)"""


@check("interval_mixed_lengths", f"""with {MIXED} select event_id, count(*) as n, min(place) as lowest, max(place) as highest
    from spans join marks using (chrom) where place between lo and hi group by event_id""")
def _(spark, sf):
    marks = table(spark, sf, "events").filter("event_id % 97 < 3").select(
        F.col("event_type").alias("chrom"), (F.col("event_id") * 9973 % 1000003 * 10).alias("at"))
    pairs = iv.bucketed_join(mixed_spans(spark, sf), marks, F.col("lo"), F.col("hi"), F.col("at"))
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("r.at").alias("lowest"), F.max("r.at").alias("highest"))


@check("partitioned_join_range", sql("features", """select f.chrom, f.start, b.start as other, b.pvalue
    from features f join features b on b.chrom = f.chrom and b.value between f.value - f.pvalue / 500
    and f.value + f.pvalue / 500 where b.start <> f.start"""))
def _(spark, sf):
    f = features(spark, sf)
    width = F.col("pvalue") / 500
    return partitioned_join(f, f, "chrom", F.col("l.start") != F.col("r.start"),
                            [F.col("l.chrom"), F.col("l.start"), F.col("r.start").alias("other"), F.col("r.pvalue")],
                            between=(F.col("value") - width, F.col("value") + width, F.col("value")), piece_rows=500)


@check("stored_interval_join", sql("features bins hits", "select chrom, seq_start, mot_start, mot_stop, motif_id, log2FC from hits"))
def _(spark, sf):
    path = scratch_path(spark, "colocated")
    name = path.rsplit("-", 1)[-1]
    b = cl.store_intervals(bins(spark, sf), f"bins_{name}", f"{path}/bins", F.col("start"), F.col("end"), buckets=8)
    m = cl.store_positions(features(spark, sf), f"matches_{name}", f"{path}/matches", F.col("start"), buckets=8)
    pairs = cl.stored_join(b, m, F.col("l.end") >= F.col("r.stop"))
    return pairs.select(F.col("l.chrom").alias("chrom"), F.col("l.start").alias("seq_start"), F.col("r.start").alias("mot_start"),
                        F.col("r.stop").alias("mot_stop"), F.col("r.motif_id").alias("motif_id"), F.col("l.log2FC").alias("log2FC"))
