"""Genomic tables made from the driver's tables, in Spark and as SQL.

A recipe is a function of whole input tables. ``CTES`` holds the same recipe as a common
table expression for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locuskit.session import tune


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred once and then given."""
    tune(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def base(index: Column) -> Column:
    return F.substring(F.lit("ACGT"), (index % 4 + 1).cast("int"), F.lit(1))


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif matches: one per event."""
    e = table(spark, sf_dir, "events")
    motif = F.col("user_id") % 40
    stop = F.col("event_id") + F.floor("value") % 20
    p = (F.col("event_id") * 7919 % 10007) / F.lit(10007.0)
    return e.select(
        F.col("event_type").alias("chrom"), F.col("event_id").alias("start"), stop.alias("stop"),
        F.concat(F.lit("MA"), text(motif)).alias("motif_id"),
        F.concat(F.lit("MA"), text(motif), F.lit(".1.TF"), text(motif % 15)).alias("motif_alt_id"),
        p.alias("pvalue"), F.col("value"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay bins: 300 wide, one per step of 50 that has an event."""
    e = table(spark, sf_dir, "events")
    s = F.col("start")
    return (e.select(F.col("event_type").alias("chrom"),
                     (F.col("event_id") - F.col("event_id") % 50).alias("start")).distinct()
            .select("chrom", "start", (s + 300).alias("end"),
                    (s * 37 % 1000 / F.lit(250.0) - 1.5).alias("log2FC"),
                    (s % 100 == 0).alias("train"), (s % 250 == 0).alias("test")))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted effects: one per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("chrom"), F.col("event_id").alias("allele_pos"),
        base(F.col("event_id")).alias("ref_allele"),
        base(F.col("event_id") + 1 + F.col("user_id") % 3).alias("allele"),
        ((F.col("value") - 50) / 100).alias("log2FC"))


def mpra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured effects: one per line item, many per variant."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    return li.select(
        F.when(part % 2 == 0, "Enhancers").otherwise("Promoters").alias("region_type"),
        F.concat(F.lit("R"), text(F.floor(part / 50))).alias("region"),
        F.concat(F.lit("chr"), text(F.floor(part / 200))).alias("chrom"),
        part.alias("allele_pos"), base(part).alias("ref_allele"),
        base(part + 1 + F.col("l_linenumber") % 3).alias("alt_allele"),
        F.floor("l_quantity").alias("Tags"), (F.col("l_tax") - F.col("l_discount")).alias("Value"),
        (F.col("l_extendedprice") / 200000).alias("p_value"),
        F.concat(F.lit("R"), text(F.floor(part / 50)), F.lit("."), F.col("l_returnflag"),
                 F.col("l_linestatus")).alias("experiment"))


def variant_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for measured variants: two per part, alternative and value by key."""
    p = table(spark, sf_dir, "part")
    part = F.col("p_partkey")
    return (p.select("p_partkey", "p_size", "p_retailprice",
                     F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
            .select(F.concat(F.lit("chr"), text(F.floor(part / 200))).alias("chrom"),
                    part.alias("allele_pos"),
                    base(part + F.when(F.col("p_size") == 1, 1).otherwise(0)).alias("ref_allele"),
                    base(part + F.col("i")).alias("alt_allele"),
                    ((F.col("p_retailprice") * F.col("i") % 101 - 50) / 25).alias("log2FC")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured regions: 80 wide, one per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, "Enhancers").otherwise("Promoters").alias("region_type"),
        F.concat(F.lit("R"), text(k)).alias("region"),
        F.concat(F.lit("chr"), text(k % 5)).alias("chrom"), (k * 100).alias("start_pos"),
        (k * 100 + 79).alias("end_pos"))


def element_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted positions of elements: first and last of each line item's stretch."""
    k = F.col("l_orderkey")
    start = k * 100 + 10 * F.col("l_linenumber")
    size = F.floor("l_quantity") % 25
    return (table(spark, sf_dir, "lineitem")
            .select(F.concat(F.lit("chr"), text(k % 5)).alias("chrom"), start.alias("cre_start"),
                    (start + size + 1).alias("cre_end"),
                    F.explode(F.array(start, start + size)).alias("allele_pos")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and score of each labelled document."""
    d = table(spark, sf_dir, "documents")
    return (table(spark, sf_dir, "labels").join(d.select("doc_id", "lang", "source", "n_chars"), "doc_id")
            .select("doc_id", "quality", "toxic", "lang", "source",
                    (F.col("n_chars") % 1000 - 400).cast("double").alias("score")))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two DNA and three RNA replicates: one row per line item, some NULL."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("input_rep1"),
        F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("input_rep2"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("output_rep1"),
        (F.col("l_tax") * 100).alias("output_rep2"),
        F.floor(F.col("l_extendedprice") % 97).cast("double").alias("output_rep3"))


def dna(column: str | Column) -> Column:
    """Letters of a text mapped to bases, everything else to N."""
    lowered = F.lower(F.col(column) if isinstance(column, str) else column)
    return F.regexp_replace(F.translate(lowered, "abcdefghijklmnopqrstuvwxyz",
                                        "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "N")


def part_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences from part names, brands and types."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), dna(F.concat("p_name", "p_type", "p_brand")).alias("seq"))


DNA_SQL = ("regexp_replace(translate(lower({0}), 'abcdefghijklmnopqrstuvwxyz', "
           "'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g')")

CTES = {
    "features": """features as (select event_type as chrom, event_id as start,
        event_id + cast(floor(value) as bigint) % 20 as stop, 'MA' || (user_id % 40) as motif_id,
        'MA' || (user_id % 40) || '.1.TF' || (user_id % 40 % 15) as motif_alt_id,
        'TF' || (user_id % 40 % 15) as motif_name,
        cast(event_id * 7919 % 10007 as double) / 10007.0::double as pvalue, value from events)""",
    "bins": """bins as (select chrom, start, start + 300 as "end",
        cast(start * 37 % 1000 as double) / 250.0::double - 1.5::double as log2FC,
        start % 100 = 0 as train, start % 250 = 0 as test
        from (select distinct event_type as chrom, event_id - event_id % 50 as start from events))""",
    "preds": """preds as (select event_type as chrom, event_id as allele_pos,
        substr('ACGT', cast(event_id % 4 + 1 as bigint), 1) as ref_allele,
        substr('ACGT', cast((event_id + 1 + user_id % 3) % 4 + 1 as bigint), 1) as allele,
        (value - 50) / 100 as log2FC from events)""",
    "hits": """hits as (select b.chrom, b.start as seq_start, b."end" as seq_end, b.log2FC, b.train,
        b.test, f.* exclude (chrom, start, stop, pvalue, value, back), f.start as mot_start,
        f.stop as mot_stop from (select *, unnest(range(7)) * 50 as back from features) f
        join bins b on b.chrom = f.chrom and b.start = f.start - f.start % 50 - back
        where f.stop <= b."end")""",
    "pairs": """pairs as (select f.chrom, f.start, f.motif_id, g.motif_id as motif2_id,
        f.motif_name, g.motif_name as motif2_name, f.stop - f.start as motif_length,
        there - f.start as motif_distance from (select *, unnest(generate_series(stop + 1, start + 100))
        as there from features) f join features g on g.chrom = f.chrom and g.start = there
        where g.stop <= f.start + 100)""",
    "mut_hits": """mut_hits as (select f.chrom, place as allele_pos, p.ref_allele, p.allele as alt_allele,
        p.log2FC, f.start as mot_start, f.stop as mot_end, f.motif_id, f.motif_alt_id, f.motif_name
        from (select *, unnest(generate_series(start - 5, stop + 5)) as place from features) f
        join preds p on p.chrom = f.chrom and p.allele_pos = place)""",
    "combos": """spots as (select *, row_number() over (in_bin order by mot_start, motif_id) as i,
        row_number() over (partition by chrom, seq_start, seq_end, motif_id) as again,
        count(*) over in_bin as n from hits window in_bin as (partition by chrom, seq_start, seq_end)),
        combos as (select chrom, seq_start, seq_end, n as num_hits, count(*) filter (again = 1) as num_tfs,
        max(mot_start) filter (i = n) - max(mot_start) filter (i = 1) as max_motif_dist,
        string_agg(motif_name, ', ' order by i) as motif_names,
        string_agg(motif_name, ', ' order by motif_name) as motif_names_o, any_value(log2FC) as log2FC,
        any_value(train) as train, any_value(test) as test from spots x where exists (select 1 from hits a
        join hits b on a.chrom = b.chrom and a.seq_start = b.seq_start and b.mot_start > a.mot_stop
        where a.chrom = x.chrom and a.seq_start = x.seq_start) group by chrom, seq_start, seq_end, n)""",
    "mpra": """mpra as (select case when l_partkey % 2 = 0 then 'Enhancers' else 'Promoters' end
        as region_type, 'R' || (l_partkey // 50) as region, 'chr' || (l_partkey // 200) as chrom,
        l_partkey as allele_pos, substr('ACGT', l_partkey % 4 + 1, 1) as ref_allele,
        substr('ACGT', (l_partkey + 1 + l_linenumber % 3) % 4 + 1, 1) as alt_allele,
        cast(floor(l_quantity) as bigint) as Tags, l_tax - l_discount as Value,
        l_extendedprice / 200000 as p_value,
        'R' || (l_partkey // 50) || '.' || l_returnflag || l_linestatus as experiment
        from lineitem)""",
    "variant_preds": """variant_preds as (select 'chr' || (p_partkey // 200) as chrom,
        p_partkey as allele_pos,
        substr('ACGT', (p_partkey + case when p_size = 1 then 1 else 0 end) % 4 + 1, 1)
        as ref_allele, substr('ACGT', (p_partkey + i) % 4 + 1, 1) as alt_allele,
        (p_retailprice * i % 101 - 50) / 25 as log2FC
        from part, (values (1), (2)) t(i))""",
    "best": """best as (select * from (select *, row_number() over (partition by region_type,
        region, chrom, allele_pos, ref_allele, alt_allele order by abs(Value) desc,
        experiment desc, Value desc, p_value desc, Tags desc) as rn from mpra) where rn = 1)""",
    "matched": """matched as (select b.region_type, b.region, b.chrom, b.allele_pos, b.ref_allele,
        p.ref_allele as pred_ref_allele, b.alt_allele, p.log2FC, b.Value as mpra_max_log2effect,
        b.p_value as mpra_p_value, b.Tags as mpra_tags, b.experiment as mpra_experiment
        from best b join variant_preds p on b.chrom = p.chrom and b.allele_pos = p.allele_pos
        and b.alt_allele = p.alt_allele)""",
    "regions": """regions as (select case when o_orderkey % 2 = 0 then 'Enhancers'
        else 'Promoters' end as region_type, 'R' || o_orderkey as region,
        'chr' || (o_orderkey % 5) as chrom, o_orderkey * 100 as start_pos,
        o_orderkey * 100 + 79 as end_pos from orders)""",
    "element_preds": """element_preds as (select chrom, cre_start, cre_start + size + 1 as cre_end,
        cre_start + size * i as allele_pos from (select 'chr' || (l_orderkey % 5) as chrom,
        l_orderkey * 100 + 10 * l_linenumber as cre_start,
        cast(floor(l_quantity) as bigint) % 25 as size from lineitem), (values (0), (1)) t(i))""",
    "coverage": """coverage as (select r.region_type, r.region, r.chrom, r.start_pos, r.end_pos,
        80::bigint as region_length, s.cre_start, s.cre_end, s.span[1] as pred_start,
        s.span[-1] as pred_end, s.span[-1] - s.span[1] + 1 as pred_length,
        round((s.span[-1] - s.span[1] + 1) * 100 / 80.0::double, 1) as region_cov
        from regions r left join (select allele_pos // 100 as slot, chrom, cre_start, cre_end,
        list_sort(list(allele_pos)) as span from element_preds where allele_pos % 100 < 80
        group by all) s on s.chrom = r.chrom and s.slot * 100 = r.start_pos)""",
    "labelled": """labelled as (select l.doc_id, l.quality, l.toxic, d.lang, d.source,
        cast(d.n_chars % 1000 - 400 as double) as score
        from labels l join documents d using (doc_id))""",
    "replicates": """replicates as (select l_orderkey, l_linenumber, l_partkey,
        l_quantity as input_rep1, floor(l_extendedprice / 1000) as input_rep2,
        case when l_discount > 0 then l_discount * 100 end as output_rep1,
        l_tax * 100 as output_rep2, floor(l_extendedprice % 97) as output_rep3 from lineitem)""",
    "part_seqs": f"""part_seqs as (select p_partkey as id,
        {DNA_SQL.format("p_name || p_type || p_brand")} as seq from part)""",
}


def sql(ctes: str, body: str) -> str:
    """``body`` behind the named common table expressions."""
    return "with " + ", ".join(CTES[c] for c in ctes.split()) + " " + body
