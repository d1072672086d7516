"""Sequences, k-mer models, and readers of files written from the driver's tables."""

from pyspark.sql import functions as F

from checks.recipes import DNA_SQL, base, bins, dna, part_seqs, sql, table, text
from checks.registry import check
from locuskit.functions import revcomp
from locuskit.operators import placement as pl
from locuskit.operators import sequences as se
from locuskit.session import scratch_path
from locuskit.sources import readers as rd
from locuskit.sources import tables as tb


def model(spark, sf, k=3):
    """Weight of a k-mer: how often it occurs in all part sequences."""
    return (se.kmer_counts(part_seqs(spark, sf), ["id"], "seq", k).filter("window is not null")
            .groupBy(F.col("window").alias("kmer")).agg(F.sum("n").cast("double").alias("weight")))


KMERS = """kmers as (select id, i, substr(seq, i, 3) as kmer from (select id, seq,
    unnest(generate_series(1, length(seq) - 2)) as i from part_seqs)),
    model as (select kmer, cast(count(*) as double) as weight from kmers group by kmer)"""


@check("assemble_sequences", """select 'S' || l_suppkey as region, string_agg(r, '' order by p, r) as seq
    from (select distinct l_suppkey, l_partkey as p, l_returnflag as r from lineitem)
    group by l_suppkey""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), text("l_suppkey")).alias("region"),
        F.col("l_partkey").alias("allele_pos"), F.col("l_returnflag").alias("ref_allele"))
    return se.assemble_sequences(rows)


@check("kmer_score", sql("part_seqs", "") + ", " + KMERS
       + " select id, sum(weight) as score from kmers join model using (kmer) group by id")
def _(spark, sf):
    return se.kmer_score(part_seqs(spark, sf), model(spark, sf), 3)


@check("kmer_score_documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", dna("text").alias("seq"))
    return se.kmer_score(docs, model(spark, sf), 3, ["doc_id"], missing="zero")


@check("saturation_variants", sql("part_seqs", """select id, i - 1 as pos, ref, alt from (select *,
    unnest(['A', 'C', 'G', 'T']) as alt from (select id, i, substr(seq, i, 1) as ref from (select id,
    seq, unnest(generate_series(1, length(seq))) as i from part_seqs))) where alt <> ref"""))
def _(spark, sf):
    return se.saturation_variants(part_seqs(spark, sf))


DELTA = """, w as (select id, i, substr(seq, i, 5) as win from (select id, seq,
    unnest(generate_series(1, length(seq) - 4)) as i from seqs)),
    v as (select *, substr(win, 1, 2) || alt || substr(win, 4, 2) as mut from (select *,
    substr(win, 3, 1) as ref, unnest(['A', 'C', 'G', 'T']) as alt from w) where alt <> ref),
    o as (select *, substr(win, o, 3) as old, substr(mut, o, 3) as new
    from (select *, unnest([1, 2, 3]) as o from v)),
    delta as (select id, i - 1 + 2 as pos, ref, alt, sum(coalesce(n.weight, 0) - coalesce(m.weight, 0))
    as score from o left join model m on m.kmer = o.old left join model n on n.kmer = o.new
    group by all)"""


@check("delta_kmer_score", sql("part_seqs", "") + ", " + KMERS
       + ", seqs as (select * from part_seqs)" + DELTA + " select * from delta")
def _(spark, sf):
    return se.delta_kmer_score(part_seqs(spark, sf), model(spark, sf), 3, missing="zero")


SIZE = 64


def chunks(spark, sf):
    """A chunked genome: each benchmark text is a chromosome."""
    b = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), text("item_id")).alias("chrom"), dna("text").alias("s"))
    step = F.explode(F.sequence(F.lit(0), F.char_length("s") - 1, F.lit(SIZE))).alias("i")
    return b.select("chrom", "s", step).select(
        "chrom", F.col("i").cast("bigint").alias("chunk_start"),
        F.lower(F.substring("s", F.col("i") + 1, F.lit(SIZE))).alias("sequence"))


@check("score_regions", sql("part_seqs", "") + ", " + KMERS + f""", seqs as (select item_id as id,
    {DNA_SQL.format("text")} as seq from benchmark)""" + DELTA + """ select 'R' || id as region,
    'b' || id as chrom, pos as allele_pos, ref as ref_allele, alt as alt_allele,
    case when id % 2 = 0 then score else 2 * score end as log2FC from delta""")
def _(spark, sf):
    k = F.col("item_id")
    regions = table(spark, sf, "benchmark").select(
        F.when(k % 2 == 0, "Enhancers").otherwise("Promoters").alias("region_type"),
        F.concat(F.lit("R"), text(k)).alias("region"), F.concat(F.lit("b"), text(k)).alias("chrom"),
        F.lit(2).alias("start_pos"), (F.char_length("text") - 3).alias("end_pos"))
    weights = model(spark, sf)
    double = weights.withColumn("weight", F.col("weight") * 2)
    return se.score_regions(regions, chunks(spark, sf), SIZE,
                            {"Enhancers": (weights, 3), "Promoters": (double, 3)}, "zero")


# Each text is changed at one place: its middle tenth taken out, or sevenfold N put in, or thirty
# letters doubled; odd ones are read from the other strand. ``a``, ``qb`` and ``tb`` are where the left
# part ends on both, and where the right part begins on the query and on the target.
TURNED = f"""docs as (select item_id as region, {DNA_SQL.format("text")} as seq from benchmark),
    spots as (select *, cast(floor(length(seq) * 0.45::double) as bigint) as a, case when region // 2 % 3 = 0
    then cast(floor(length(seq) * 0.55::double) as bigint) else cast(floor(length(seq) * 0.45::double) as bigint)
    end as tb, case region // 2 % 3 when 0 then '' when 1 then 'NNNNNNN' else
    right(substr(seq, 1, cast(floor(length(seq) * 0.45::double) as bigint)), 30) end as ins from docs),
    cuts as (select *, a + length(ins) as qb, substr(seq, 1, a) || ins || substr(seq, tb + 1) as cut from spots),
    query as (select region, case when region % 2 = 0 then cut
    else reverse(translate(cut, 'ACGT', 'TGCA')) end as seq from cuts)"""
# the left part also takes the letters that go on alike, and the right part begins behind them
BLOCKS = """ext as (select *, (select coalesce(min(i), least(length(cut), length(seq)) - a) from
    (select unnest(generate_series(0, least(length(cut), length(seq)) - a - 1)) as i)
    where substr(cut, a + i + 1, 1) <> substr(seq, a + i + 1, 1)) as e from cuts),
    pieces as (select region, case when region % 2 = 0 then 1 else -1 end as strand, 0 as block,
    0::bigint as t_start, a + e as t_end, 0::bigint as q_start, a + e as q_end from ext union all
    select region, case when region % 2 = 0 then 1 else -1 end, 1, tb + e, length(seq)::bigint, qb + e,
    length(cut)::bigint from ext)"""


def turned(spark, sf):
    """Whole texts as targets, changed ones as queries."""
    docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("region"), dna("text").alias("seq"))
    kind = F.floor(F.col("region") / 2) % 3
    n = F.char_length("seq")
    a, b = F.floor(n * 0.45).cast("int"), F.floor(n * 0.55).cast("int")
    left = F.substring("seq", F.lit(1), a)
    extra = F.when(kind == 0, "").when(kind == 1, "NNNNNNN").otherwise(F.right(left, F.lit(30)))
    rest = F.substring("seq", F.when(kind == 0, b).otherwise(a) + 1, n)
    cut = F.concat(left, extra, rest)
    query = docs.select("region", F.when(F.col("region") % 2 == 0, cut).otherwise(revcomp(cut)).alias("seq"))
    return query, docs


@check("place_by_kmers", f"with {TURNED}, {BLOCKS} select * from pieces")
def _(spark, sf):
    query, docs = turned(spark, sf)
    return pl.place_by_kmers(query, docs).drop("votes")


REL = """rel as (select region, i, substr(seq, i + 1, 1) as ref, unnest(['A', 'C', 'G', 'T']) as alt from
    (select *, unnest(generate_series(0, length(seq) - 1)) as i from query))"""


def changes(seqs):
    return se.saturation_variants(seqs, ["region"]).select(
        "region", F.col("pos").alias("rel_pos"), F.col("ref").alias("ref_allele"), F.col("alt").alias("alt_allele"))


# The positions and letters are read off the target itself: every letter of it that the query
# holds, with each other base, and nothing else.
@check("positions_on_target", f"""with {TURNED}, {BLOCKS}, here as (select region, substr(d.seq, p + 1, 1) as letter, p
    from (select region, unnest(generate_series(t_start, t_end - 1)) as p from pieces) join docs d using (region))
    select region, p as rel_pos, letter as ref_allele, alt as alt_allele
    from here, (values ('A'), ('C'), ('G'), ('T')) v(alt) where translate(alt, 'ACGT', 'TGCA') <> translate(letter,
    'ACGT', 'TGCA')""")
def _(spark, sf):
    query, docs = turned(spark, sf)
    return pl.positions_on_target(changes(query), pl.place_by_kmers(query, docs))


@check("remap_positions", f"""with {TURNED}, {BLOCKS}, {REL},
    sizes as (select region, length(seq) as n from query),
    gaps as (select x.region, x.strand, x.q_end as a, y.q_start as b, x.q_start as first
    from pieces x join pieces y using (region) where x.block = 0 and y.block = 1),
    turn as (select region, case when strand = -1 then n - 1 - i else i end as p, a, b, first,
    case when strand = -1 then translate(ref, 'ACGT', 'TGCA') else ref end as ref_allele,
    case when strand = -1 then translate(alt, 'ACGT', 'TGCA') else alt end as alt_allele
    from rel join gaps using (region) join sizes using (region) where alt <> ref)
    select region, p - first - case when p >= b then b - a else 0 end as rel_pos, ref_allele, alt_allele
    from turn where not (p >= a and p < b)""")
def _(spark, sf):
    query, docs = turned(spark, sf)
    return pl.remap_positions(changes(query), pl.place_by_kmers(query, docs))


# Readers: the driver's tables are written in the layout of an input file, then read.

def lines(df, *columns):
    return df.select(F.concat_ws("\t", *columns).alias("value"))


@check("table_roundtrip", "select event_id, user_id, event_type, value from events")
def _(spark, sf):
    path = scratch_path(spark, "events")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    tb.write_table(e, path, ["event_type"], "delete_matching")
    return tb.read_table(spark, path)


@check("stored_flags", sql("bins", "select * from bins"))
def _(spark, sf):
    path = scratch_path(spark, "bins")
    stored = tb.materialize_if_absent(spark, path, lambda: bins(spark, sf), ["chrom", "train", "test"])
    again = tb.materialize_if_absent(spark, path, lambda: stored.limit(0))
    names = again.columns
    return tb.read_table(spark, path, ["train", "test"]).select(*names)


@check("read_bins", """select row_number() over (order by event_id) - 1 as index, event_type as chrom,
    event_id as start, event_id + 300 as "end", user_id as input_rep1, user_id + 1 as output_rep1,
    value as log2FC from events""")
def _(spark, sf):
    path = scratch_path(spark, "bins-tsv")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("chrom"), F.col("event_id").alias("start"),
        (F.col("event_id") + 300).alias("end"), F.col("user_id").alias("input_rep1"),
        (F.col("user_id") + 1).alias("K562_rep1"), F.col("value").alias("K562_log2FC"))
    tb.export_delimited(e, path, gzip=True)
    return rd.read_bins(spark, path)


@check("motif_scan", """select * from (select user_id % 9 || '' as motif_id, event_type as chrom,
    event_id as start, event_id + 8 as stop, value / 1000 as pvalue, value / 100 as qvalue
    from events) where qvalue <= 0.1""")
def _(spark, sf):
    source, target = scratch_path(spark, "scan"), scratch_path(spark, "matches")
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 9).alias("motif_id"), F.col("event_type").alias("sequence_name"),
        F.col("event_id").alias("start"), (F.col("event_id") + 8).alias("stop"),
        (F.col("value") / 1000).alias("p-value"), (F.col("value") / 100).alias("q-value"))
    tb.export_delimited(e, source)
    rd.ingest_motif_scan(spark, source, target)
    return tb.read_table(spark, target)


PLACED = """p as (select 'chr' || (l_orderkey % 5) as chrom, l_orderkey * 10 as s, l_partkey as pos,
    substr('ACGT', l_partkey % 4 + 1, 1) as ref_allele, unnest(['A', 'C', 'G', 'T']) as allele,
    l_orderkey, l_linenumber, l_tax - l_discount as v from lineitem)"""


#: Rows of a gzip part of prediction files, as its reader is one task.
PART_ROWS = 1_000_000


def placed(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("chr"), text(F.col("l_orderkey") % 5)).alias("chrom"),
        (F.col("l_orderkey") * 10).alias("s"), F.col("l_partkey").alias("pos"),
        base(F.col("l_partkey")).alias("ref_allele"),
        F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("allele"), "l_orderkey", "l_linenumber",
        (F.col("l_tax") - F.col("l_discount")).alias("v"))


def write_raw(p, path):
    s, v = F.col("s"), F.col("v")
    x = F.when(F.col("allele") == "A", 0 - v).otherwise(v * F.ascii("allele"))
    span = lambda a, b: F.concat("chrom", F.lit(":"), text(a), F.lit("-"), text(b))
    lines(p, span(s, s + 238), span(s - s % 3, s + 300), F.concat(F.lit("pos="), text("pos")),
          F.concat(F.lit("ref="), "ref_allele"), "allele", text(x)).write.options(compression="gzip", maxRecordsPerFile=PART_ROWS).text(path)


@check("allele_preds_raw", f"""with {PLACED} select chrom as cre_chrom, s as cre_start,
    s + 238 as cre_end, chrom as bin_chrom, s - s % 3 as bin_start, s + 300 as bin_end,
    pos as allele_pos, ref_allele, allele, round(x / ln(2), 9) as log2FC,
    round(x / ln(2) - max(x / ln(2)) filter (allele = ref_allele) over (partition by chrom, s, pos), 9)
    as "FC_to_ref" from (select *, case when allele = 'A' then 0 - v else v * ascii(allele) end as x
    from p)""")
def _(spark, sf):
    path = scratch_path(spark, "raw")
    write_raw(placed(spark, sf), path)
    out = rd.read_allele_preds_raw(spark, path)
    return out.withColumns({c: F.round(c, 9) for c in ("log2FC", "FC_to_ref")})


@check("ingest_raw_preds", f"""with {PLACED}, x as (select *, case when allele = 'A' then 0 - v else v * ascii(allele)
    end as x from p), ref as (select s, pos, max(x) as r from x where allele = ref_allele group by s, pos)
    select chrom, s as cre_start, s + 238 as cre_end, chrom as bin_chrom, s - s % 3 as bin_start, s + 300 as bin_end,
    pos as allele_pos, ref_allele, allele, round(x, 9) as effect, round(x - r, 9) as "log2FC"
    from x join ref using (s, pos) where allele <> ref_allele""")
def _(spark, sf):
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "raw-preds")
    write_raw(placed(spark, sf), source)
    rd.ingest_allele_preds(spark, source, target, form="raw")
    out = tb.read_table(spark, target)
    return out.withColumns({c: F.round(c, 9) for c in ("effect", "log2FC")})


@check("allele_preds_spdi", f"""with {PLACED} select chrom, s as cre_start, s + 238 as cre_end,
    v as log2FC, pos as allele_pos, ref_allele, allele from p""")
def _(spark, sf):
    source, target = scratch_path(spark, "spdi"), scratch_path(spark, "allele-preds")
    p = placed(spark, sf)
    spdi = F.concat_ws(":", F.lit("NC_1"), text("pos"), "ref_allele", "allele")
    tb.export_delimited(p.select(
        F.col("chrom").alias("chromosome"), F.col("s").alias("cre_start"),
        (F.col("s") + 238).alias("cre_end"), spdi.alias("SPDI"), F.col("v").alias("effect")), source, gzip=True, most_rows=PART_ROWS)
    rd.ingest_allele_preds(spark, source, target, chrom="chromosome", cre_start=None)
    return tb.read_table(spark, target)


@check("mpra_files", """select 'chr' || (l_suppkey % 5) as chrom, l_partkey as allele_pos,
    substr('ACGT', l_partkey % 4 + 1, 1) as ref_allele, l_returnflag as alt_allele,
    cast(l_linenumber as bigint) as "Tags", l_suppkey as "DNA", l_partkey as "RNA", l_tax as "Value",
    l_discount as p_value, 'R' || l_linestatus || '.x1' as experiment,
    case when l_linestatus = 'F' then 'Enhancers' else 'Promoters' end as region_type,
    'R' || l_linestatus as region from lineitem where l_returnflag <> 'R' and l_discount > 0""")
def _(spark, sf):
    root = scratch_path(spark, "mpra")
    li = table(spark, sf, "lineitem")
    rows = li.select(
        text(F.col("l_suppkey") % 5).alias("Chromosome"), (F.col("l_partkey") + 1).alias("Position"),
        base(F.col("l_partkey")).alias("Ref"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_returnflag")).alias("Alt"),
        F.col("l_linenumber").alias("Tags"), F.col("l_suppkey").alias("DNA"),
        F.col("l_partkey").alias("RNA"), F.col("l_tax").alias("Value"),
        F.when(F.col("l_discount") > 0, text("l_discount")).otherwise("NA").alias("P-Value"), "l_linestatus")
    for status, kind in (("F", "Enhancers"), ("O", "Promoters")):
        part = rows.filter(F.col("l_linestatus") == status).drop("l_linestatus")
        # the name of the folder carries the experiment, as a file name does in the source
        tb.export_delimited(part, f"{root}/{kind}/GRCh38_R{status}.x1.tsv")
    out = rd.read_mpra(spark, root)
    return out.drop("file_path")


@check("relative_preds", """select l_partkey as rel_pos, l_returnflag as ref_allele,
    l_linestatus as alt_allele, l_tax as log2fc, 'Enhancers' as region_type,
    'R' || l_linestatus as region, case when l_linestatus = 'F' then 'HepG2' else 'K562' end
    as cell_line, 'Dnase' as experiment from lineitem where l_discount > 0""")
def _(spark, sf):
    root = scratch_path(spark, "relative")
    rows = table(spark, sf, "lineitem").select(
        text(F.col("l_partkey") + 1).alias("a"), "l_returnflag", "l_linestatus",
        F.when(F.col("l_discount") > 0, text("l_tax")).otherwise("NA").alias("d"))
    for status, cell in (("F", "HepG2"), ("O", "K562")):
        tb.export_delimited(rows.filter(F.col("l_linestatus") == status),
                            f"{root}/Enhancers/R{status}-Dnase-{cell}.tsv", header=False)
    return rd.read_relative_preds(spark, root).drop("file_path")


@check("fasta_bins", """select event_id as index, 'chr' || (event_id % 22) as chrom,
    user_id as start, user_id + 300 as "end" from events""")
def _(spark, sf):
    path = scratch_path(spark, "fasta")
    e = table(spark, sf, "events")
    head = F.concat(F.lit(">"), text("event_id"), F.lit(" /coord=chr"), text(F.col("event_id") % 22),
                    F.lit(":"), text("user_id"), F.lit("-"), text(F.col("user_id") + 300))
    e.select(F.explode(F.array(head, F.col("event_type"))).alias("value")).write.text(path)
    return rd.read_fasta_bins(spark, path)


@check("bayes_calls", """select 'chr' || (l_suppkey % 5) as chrom, l_partkey as allele_pos,
    l_linestatus as ref_allele, l_returnflag as alt_allele, l_quantity as theta, l_tax as "lowerCI",
    l_discount as "upperCI", l_extendedprice as "P_reg" from lineitem where l_linenumber <> 3""")
def _(spark, sf):
    path = scratch_path(spark, "calls")
    lines(table(spark, sf, "lineitem"), variant_id(), text("l_quantity"), text("l_tax"),
          text("l_discount"), text("l_extendedprice")).write.text(path)
    return rd.read_bayes_calls(spark, path)


def variant_id():
    alt = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 3, "C").otherwise(""))
    return F.concat_ws(":", F.concat(F.lit("chr"), text(F.col("l_suppkey") % 5)),
                       text(F.col("l_partkey") + 1), "l_linestatus", alt)


@check("bayes_counts", """select 'chr' || (l_suppkey % 5) as chrom, l_partkey as allele_pos,
    l_linestatus as ref_allele, l_returnflag as alt_allele, 1::bigint as n_inputs,
    l_suppkey as input1_ref, nullif(l_linenumber::bigint, 2) as input1_alt, 2::bigint as n_outputs,
    l_partkey as output1_ref, 5::bigint as output1_alt, 7::bigint as output2_ref,
    l_suppkey as output2_alt, l_suppkey::double as avg_input_ref,
    nullif(l_linenumber, 2)::double as avg_input_alt, (l_partkey + 7) / 2 as avg_output_ref,
    (5 + l_suppkey) / 2 as avg_output_alt,
    least(l_suppkey, nullif(l_linenumber, 2), (l_partkey + 7) / 2, (5 + l_suppkey) / 2) as min_avg_count,
    round(((5 + l_suppkey) / 2) / ((l_partkey + 7) / 2)
    / nullif(nullif(l_linenumber, 2) / nullif(l_suppkey, 0), 0), 9) as naive_theta
    from lineitem where l_linenumber <> 3""")
def _(spark, sf):
    path = scratch_path(spark, "counts")
    n = F.col("l_linenumber")
    lines(table(spark, sf, "lineitem"), variant_id(), F.lit("1"), text("l_suppkey"),
          F.when(n == 2, "NA").otherwise(text(n)), F.lit("2"), text("l_partkey"), F.lit("5"),
          F.lit("7"), text("l_suppkey")).write.text(path)
    return rd.read_bayes_counts(spark, path).withColumn("naive_theta", F.round("naive_theta", 9))


# Three files, later ones repeat k-mers with other weights: of all lines that name a k-mer or its
# reverse complement the last one counts.
@check("kmer_weights", sql("part_seqs", "") + ", " + KMERS + """, rows as (select 1 as file, kmer, weight from model
    union all select 2, kmer, weight + 1000 from model where weight::bigint % 2 = 0 union all
    select 3, kmer, 0 - weight from model where weight::bigint % 3 = 0),
    named as (select kmer as name, file, kmer, 0 as turn, weight from rows union all
    select reverse(translate(kmer, 'ACGT', 'TGCA')), file, kmer, 1, weight from rows)
    select name as kmer, weight from (select *, row_number() over (partition by name
    order by file desc, kmer desc, turn desc) as i from named) where i = 1""")
def _(spark, sf):
    path, w = scratch_path(spark, "weights"), F.col("weight")
    m = model(spark, sf)
    for i, part in enumerate((m, m.filter(w % 2 == 0).withColumn("weight", w + 1000),
                              m.filter(w % 3 == 0).withColumn("weight", 0 - w)), 1):
        part.orderBy("kmer").select(F.concat_ws("  ", "kmer", text("weight")).alias("value")).write.text(f"{path}/{i}")
    return rd.read_kmer_weights(spark, f"{path}/*")


@check("cv_preds", """select event_id as index, value as "true", value / 2 as predicted from events""")
def _(spark, sf):
    path = scratch_path(spark, "cv")
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("index"), F.col("value").alias("true"), (F.col("value") / 2).alias("predicted"))
    tb.export_delimited(e, path, ",")
    return rd.read_cv_preds(spark, path)
