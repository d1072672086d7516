"""Readers, tables and sequence operators on small hand-made inputs."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from locuskit.operators import placement as pl
from locuskit.operators import sequences as se
from locuskit.operators.sampling import with_row_number
from locuskit.plans import motif_activity, region_gaps, variant_scoring
from locuskit.sources import readers as rd
from locuskit.sources import tables as tb
from locuskit.streaming.ingest import ingest_new_scans


def put(path, *lines, zipped=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if zipped else open)(path, "wt") as f:
        f.write("\n".join("\t".join(map(str, x)) if not isinstance(x, str) else x for x in lines) + "\n")
    return str(path)


def test_read_bins(spark, tmp_path, rows):
    p = put(f"{tmp_path}/b.tsv.gz", ("chrom", "start", "end", "input_rep1", "K562_rep1", "K562_log2FC"),
            ("1", 100, 400, 3, 4, 0.5), ("2", 100, 400, 3, 4, -1), zipped=True)
    df = rd.read_bins(spark, p)
    assert df.columns == ["index", "chrom", "start", "end", "input_rep1", "output_rep1", "log2FC"]
    assert rows(df, "index", "chrom", "log2FC") == [(0, "1", 0.5), (1, "2", -1.0)]


def test_mpra_edges(spark, tmp_path, rows):
    head = ("Chromosome", "Position", "Ref", "Alt", "Tags", "DNA", "RNA", "Value", "P-Value")
    put(f"{tmp_path}/m/Enhancers/GRCh38_ZFAND3.tsv", head, ("6", 101, "A", "C", 10, 5, 6, 0.1, 0.01),
        ("6", 102, "A", "-", 10, 5, 6, 0.1, 0.01), ("6", 103, "AC", "G", 10, 5, 6, 0.1, 0.01),
        ("6", 104, "A", "G", 10, 5, 6, 0.1, "NA"))
    put(f"{tmp_path}/m/Promoters/GRCh38_TERT-GBM.x.tsv", head, ("5", 7, "T", "C", 1, 2, 3, -1, 1))
    put(f"{tmp_path}/m/Promoters/other.tsv", head, ("5", 7, "T", "C", 1, 2, 3, -1, 1))
    df = rd.read_mpra(spark, f"{tmp_path}/m")
    assert rows(df, "chrom", "allele_pos", "region_type", "region", "experiment") == [
        ("chr5", 6, "Promoters", "TERT", "TERT-GBM.x"), ("chr6", 100, "Enhancers", "ZFAND3", "ZFAND3")]
    assert rd.read_mpra(spark, f"{tmp_path}/m", single_base_only=False).count() == 5


def test_relative_preds(spark, tmp_path, rows):
    put(f"{tmp_path}/g/Enhancers/F9-Dnase-HepG2.tsv", (1, "A", "C", 0.5), (2, "A", "NA", 0.5))
    put(f"{tmp_path}/g/Enhancers/F9.tsv", (1, "A", "C", 0.5))
    got = rows(rd.read_relative_preds(spark, f"{tmp_path}/g"), "rel_pos", "region", "cell_line", "experiment")
    assert got == [(0, "F9", "HepG2", "Dnase")]


def test_raw_preds(spark, tmp_path, rows):
    line = lambda a, v: ("chr4:100-338", "chr4:69-369", "pos=100", "ref=G", a, v)
    p = put(f"{tmp_path}/r.txt", line("A", -0.25), line("G", -0.75), line("T", 1))
    got = rows(rd.read_allele_preds_raw(spark, p, None), "allele", "bin_start", "FC_to_ref")
    assert got == [("A", 69, 0.5), ("G", 69, 0.0), ("T", 69, 1.75)]
    rd.ingest_allele_preds(spark, p, f"{tmp_path}/db", form="raw")
    stored = tb.read_table(spark, f"{tmp_path}/db")
    assert rows(stored, "chrom", "allele", "log2FC") == [("chr4", "A", 0.5), ("chr4", "T", 1.75)]


def test_spdi_columns_do_not_leak(spark, tmp_path):
    p = put(f"{tmp_path}/s.tsv", ("chr", "cre_start", "cre_end", "SPDI", "effect"),
            ("chr1", 1, 9, "NC:101:G:A", 0.5))
    got = rd.read_allele_preds_spdi(spark, p, chrom="chr", cre_end=None).first()
    assert (got.chrom, got.allele_pos, got.ref_allele, got.allele) == ("chr1", 101, "G", "A")
    with pytest.raises(ValueError):
        rd.read_allele_preds_spdi(spark, p, nothing="x")
    with pytest.raises(Exception, match="cre_chrom"):
        rd.read_allele_preds_spdi(spark, p).collect()


def test_fasta(spark, tmp_path, rows):
    p = put(f"{tmp_path}/x.fa", ">12 /coord=chr1:100-400", "ACGT", ">7 /coord=chrX:5-305", "AC")
    assert rows(rd.read_fasta_bins(spark, p)) == [(12, "chr1", 100, 400), (7, "chrX", 5, 305)]
    bad = put(f"{tmp_path}/y.fa", ">nothing here")
    with pytest.raises(Exception, match="malformed"):
        rd.read_fasta_bins(spark, bad).collect()


def test_bayes_counts(spark, tmp_path):
    p = put(f"{tmp_path}/c.tsv", ("chr1:101:G:A", 2, 10, 4, "NA", 8, 1, 6, 9), ("chr1:5:GT:A", 2, 1, 1, 1, 1, 1, 1, 1))
    row = rd.read_bayes_counts(spark, p).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.allele_pos, r.avg_input_ref, r.avg_input_alt, r.min_avg_count) == (100, 10.0, 6.0, 6.0)
    assert r.naive_theta == pytest.approx((9 / 6) / (6 / 10))
    bad = put(f"{tmp_path}/d.tsv", ("chr1:101:G:A", 1, 1, 1, 1, 1, 1), ("chr1:101:G:A", 2, 1, 1, 1, 1, 1))
    with pytest.raises(ValueError, match="inputs"):
        rd.read_bayes_counts(spark, bad)


def test_kmer_weights(spark, tmp_path, rows):
    p = put(f"{tmp_path}/w.txt", "AAC 1.5", "GTT  2.5", "acg 3")
    assert rows(rd.read_kmer_weights(spark, p)) == [("AAC", 2.5), ("CGT", 3.0), ("GTT", 2.5), ("acg", 3.0)]


def test_write_modes(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "v long, p string")
    b = spark.createDataFrame([(3, "y")], "v long, p string")
    tb.write_table(a, path, ["p"])
    tb.write_table(b, path, ["p"])
    assert tb.read_table(spark, path).count() == 3
    tb.write_table(b, path, ["p"], "delete_matching")
    assert rows(tb.read_table(spark, path), "v", "p") == [(1, "x"), (3, "y")]
    with pytest.raises(ValueError):
        tb.write_table(b, path, ["p"], "nonsense")


def test_row_numbers_over_many_files(spark, tmp_path, rows):
    spark.range(100).repartition(7).write.parquet(f"{tmp_path}/n")
    df = with_row_number(spark.read.parquet(f"{tmp_path}/n"), 1)
    assert sorted(r["index"] for r in df.collect()) == list(range(1, 101))


def test_streamed_scans_take_each_file_once(spark, tmp_path, rows):
    head = ("motif_id", "sequence_name", "start", "stop", "p-value", "q-value")
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/shared")
    run = lambda: ingest_new_scans(spark, f"{tmp_path}/in", f"{tmp_path}/db", list(head)).awaitTermination()
    put(f"{tmp_path}/in/chr1.tsv", head, ("m", "chr1", 1, 9, 1e-9, 0.05), ("m", "chr1", 2, 9, 0.1, 0.5))
    run()
    put(f"{tmp_path}/in/chr2.tsv", head, ("m", "chr2", 3, 9, 1e-9, 0.1))
    run()
    assert rows(tb.read_table(spark, f"{tmp_path}/db"), "chrom", "start", "pvalue") == [
        ("chr1", 1, 1e-9), ("chr2", 3, 1e-9)]


SEQ = "ACGTNacgtAGGCTTAACCGGATCGATCGGGATTACA"


@pytest.mark.parametrize("pieces", [(1 << 16, 1 << 8), (8, 4), (7, 1)])
def test_windows(spark, monkeypatch, pieces):
    monkeypatch.setattr(se, "PIECES", pieces)
    df = spark.createDataFrame([(1, SEQ), (2, "AC")], "id long, seq string")
    got = sorted((r.pos, r.window) for r in se.windows(df, ["id"], "seq", 5).collect())
    assert got == [(i, SEQ[i:i + 5]) for i in range(len(SEQ) - 4)]


def test_kmer_and_delta_scores(spark):
    seq = SEQ[9:]
    kmers = sorted({a + b for a in "ACGT" for b in "ACGT"})
    weight = {k: float(i * i % 11) for i, k in enumerate(kmers)}
    w = spark.createDataFrame(list(weight.items()), "kmer string, weight double")
    df = spark.createDataFrame([(1, seq, 50)], "id long, seq string, start long")
    score = lambda s: sum(weight[s[i:i + 2]] for i in range(len(s) - 1))
    assert se.kmer_score(df, w, 2).first().score == score(seq)
    want = {(50 + i, seq[i], b): score(seq[:i] + b + seq[i + 1:]) - score(seq)
            for i in range(1, len(seq) - 1) for b in "ACGT" if b != seq[i]}
    got = {(r.pos, r.ref, r.alt): r.score for r in se.delta_kmer_score(df, w, 2, start="start").collect()}
    assert got == want and se.kmer_length(w) == 2
    with pytest.raises(Exception, match="without weight"):
        se.kmer_score(df, w.filter("kmer <> 'AC'"), 2).collect()
    with pytest.raises(Exception, match="at least"):
        se.delta_kmer_score(df.withColumn("seq", F.lit("AC")), w, 2).collect()


def test_placement_and_positions(spark, rows):
    import random
    r = random.Random(9)
    target = "".join(r.choice("ACGT") for _ in range(300))
    # the letters next to a block differ from the target's, or the block could be longer
    other = lambda i: "C" if target[i] != "C" else "G"
    query = "ACGT" + other(9) + target[10:120] + other(120) + "TGACC" + other(119) + target[120:250]
    flip = query[::-1].translate(str.maketrans("ACGT", "TGCA"))
    targets = spark.createDataFrame([("f", target), ("r", target)], "region string, seq string")
    queries = spark.createDataFrame([("f", query), ("r", flip)], "region string, seq string")
    blocks = pl.place_by_kmers(queries, targets, 11, 5)
    spans = {(b.region, b.strand, b.t_start, b.t_end, b.q_start, b.q_end) for b in blocks.collect()}
    assert spans == {(x, s, *p) for x, s in (("f", 1), ("r", -1))
                     for p in ((10, 120, 5, 115), (120, 250, 122, 252))}
    rel = se.saturation_variants(queries, ["region"]).select(
        "region", F.col("pos").alias("rel_pos"), F.col("ref").alias("ref_allele"),
        F.col("alt").alias("alt_allele"))
    for region in "fr":
        refs = {x.rel_pos: x.ref_allele for x in pl.remap_positions(rel, blocks).collect() if x.region == region}
        assert [refs[i] for i in range(240)] == list(target[10:250])


def test_plans(spark, tmp_path, rows):
    bins = spark.createDataFrame([("c", 0, 300, 0.5, True, False), ("c", 50, 350, -1.0, False, True)],
                                 "chrom string, start long, end long, log2FC double, train boolean, test boolean")
    feats = spark.createDataFrame([("c", 10, 20, "m1", "m1.A"), ("c", 100, 110, "m2", "m2.B")],
                                  "chrom string, start long, stop long, motif_id string, motif_alt_id string")
    hits = motif_activity.stored_hits(spark, bins, feats, f"{tmp_path}/hits")
    assert hits.count() == 3
    assert rows(motif_activity.active_hits(hits, 0.1), "motif_id") == [("m1",)]
    stats, active = motif_activity.compared_datasets({"a": hits, "b": hits.filter("seq_start = 0")}, 0.1)
    assert rows(active) == [("A", 0.5), ("B", 0.5)] and stats.count() == 4
    mpra = spark.createDataFrame(
        [("E", "r", "c", p, "A", "C", 20, v, q, "x") for p, v, q in ((1, 0.9, 1e-9), (2, 0.01, 0.5), (3, -0.8, 1e-9), (4, -0.01, 0.9))],
        "region_type string, region string, chrom string, allele_pos long, ref_allele string, alt_allele string, "
        "Tags long, Value double, p_value double, experiment string")
    preds = spark.createDataFrame([("c", p, "A", "C", s, 0, 9) for p, s in ((1, 0.7), (2, 0.1), (3, -0.5), (4, 0.05))],
                                  "chrom string, allele_pos long, ref_allele string, allele string, log2FC double, cre_start long, cre_end long")
    area = variant_scoring.benchmark_auroc({"m": preds}, mpra, named=["r"])
    assert rows(area, "level", "auroc") == [("all", 1.0), ("named", 1.0), ("region", 1.0), ("region_type", 1.0)]
    from locuskit.operators import variants as va
    labelled = va.add_direction(va.add_class_labels(va.join_preds_to_mpra(preds, mpra, "allele"), 1e-5))
    report = variant_scoring.direction_report(labelled, va.class_labels(1e-5)[0])
    assert rows(report, "subset", "mcc") == [("both", 1.0), ("down", 1.0), ("up", 1.0)]
    lists = region_gaps.region_descriptors(spark, mpra, preds.filter("allele_pos in (2, 3)"), f"{tmp_path}/gaps")
    assert rows(lists["all_missing"], "region_id") == [("c:1-2",), ("c:4-5",)]


def test_row_numbers_over_files_of_any_size(spark, tmp_path):
    import random
    r, want = random.Random(1), []
    for name, n in (("b", 5), ("a", 7000), ("c", 1), ("d", 0), ("e", 300)):
        text = [f"{name}{i}\t{r.random()}" for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in text))
    for name, n in (("a", 7000), ("b", 5), ("c", 1), ("e", 300)):
        want += [f"{name}{i}" for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = with_row_number(spark.read.text(str(tmp_path)).select(F.split("value", "\t")[0].alias("v")), by_file=True)
        got = sorted((x["index"], x["v"]) for x in df.collect())
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))
    assert "Join" not in plan.split("scalar-subquery")[0]


def test_later_file_wins_over_earlier(spark, tmp_path, rows):
    for name, lines in (("2", "AC 5\nGT 6\n"), ("1", "AC 1\nCC 2\n"), ("3", "\nCC 9\n")):
        (tmp_path / f"{name}.txt").write_text(lines)
    assert rows(rd.read_kmer_weights(spark, str(tmp_path))) == [("AC", 6.0), ("CC", 9.0), ("GG", 9.0), ("GT", 6.0)]


def test_gzip_is_dealt_to_all_tasks(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "scan.tsv.gz", "wt") as f:
        f.write("motif_id\tsequence_name\tstart\tstop\tp-value\tq-value\n")
        f.writelines(f"m{i % 5}\tchr1\t{i}\t{i + 8}\t0.001\t0.01\n" for i in range(5000))
    got = rd.read_motif_scan(spark, str(tmp_path / "scan.tsv.gz"))
    assert got.rdd.getNumPartitions() == 8 and got.count() == 5000


def test_partitioned_files_follow_their_size(spark, tmp_path):
    """One with most of the rows has several files, a small one that shares no shuffle partition with it one."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 20 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("chrom"),
        F.col("id").alias("start"), F.rand(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        tb.write_table(df.repartition(16), f"{tmp_path}/t", ["chrom"], sort_by=["start"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    hot = files.pop("chrom=hot")
    assert 1 < hot < 16 and all(n in (1, hot) for n in files.values()) and sum(files.values()) < 16
    assert tb.read_table(spark, f"{tmp_path}/t").count() == 200_000
    tb.write_table(df.limit(1000), f"{tmp_path}/u", ["chrom"], most_rows=100)
    import pyarrow.parquet as pq
    assert max(pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "u").rglob("*.parquet")) <= 100


def test_chains_with_inserted_deleted_and_repeated_letters(spark):
    """Blocks rise on both sides, never overlap, and hold equal letters, on either strand."""
    import random
    r = random.Random(12)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    targets, queries = [], []
    for n in range(60):
        t = "".join(r.choice("ACGT") for _ in range(400))
        unit = t[50:70]
        t = t[:200] + unit * (n % 3) + t[200:]
        q = t
        for _ in range(3):
            at, kind = r.randrange(40, len(q) - 60), r.randrange(3)
            q = (q[:at] + q[at + r.randrange(1, 30):] if kind == 0 else
                 q[:at] + "".join(r.choice("ACGT") for _ in range(r.randrange(1, 30))) + q[at:] if kind == 1 else
                 q[:at] + q[at - 15:at] + q[at:])
        targets.append((n, t))
        queries.append((n, flip(q) if n % 2 else q))
    made = {n: (flip(q) if n % 2 else q) for n, q in queries}
    blocks = pl.place_by_kmers(spark.createDataFrame(queries, "region int, seq string"),
                               spark.createDataFrame(targets, "region int, seq string")).collect()
    held = {}
    for b in sorted(blocks, key=lambda b: (b.region, b.block)):
        assert b.strand == (-1 if b.region % 2 else 1)
        held.setdefault(b.region, []).append(b)
    assert len(held) == 60
    for n, own in held.items():
        t, q = dict(targets)[n], made[n]
        for a, b in zip(own, own[1:]):
            assert a.t_end <= b.t_start and a.q_end <= b.q_start
        assert all(t[b.t_start:b.t_end] == q[b.q_start:b.q_end] for b in own)
        assert sum(b.t_end - b.t_start for b in own) >= 0.75 * min(len(t), len(q))


def test_heaviest_chain_equals_brute_force():
    import random
    r = random.Random(2)
    for _ in range(200):
        t = r.sample(range(30), r.randrange(12))
        best = [1] * len(t)
        for i in range(len(t)):
            best[i] = 1 + max([best[j] for j in range(i) if t[j] < t[i]], default=0)
        chain = pl.rising_chain(t)
        assert len(chain) == max(best, default=0)
        assert all(a < b and t[a] < t[b] for a, b in zip(chain, chain[1:]))


def test_packed_scores_equal_plain_ones(spark):
    """Two models at once, letters without weight, against sums over all k-mers."""
    import random
    r, k = random.Random(6), 4
    weights = [(m, "".join(w), r.choice([-2.0, 0.5, 1.0, 3.0])) for m in "xy" for w in
               {tuple(r.choice("ACGTN") for _ in range(k)) for _ in range(300)}]
    seqs = [(i, m, "".join(r.choice("ACGTACGTNa") for _ in range(r.randrange(7, 30)))) for i in range(12) for m in "xy"]
    got = {tuple(x)[:5]: x.score for x in se.delta_kmer_score(
        spark.createDataFrame(seqs, "id int, m string, seq string"), spark.createDataFrame(weights, "m string, kmer string, weight double"),
        k, ["id", "m"], missing="zero", model=["m"]).collect()}
    table = {(m, w): x for m, w, x in weights}
    score = lambda m, s: sum(table.get((m, s[i:i + k]), 0.0) for i in range(len(s) - k + 1))
    want = {}
    for i, m, s in seqs:
        for p in range(k - 1, len(s) - k + 1):
            for b in "ACGT":
                if b != s[p]:
                    window = s[p - k + 1:p + k]
                    want[i, m, p, s[p], b] = score(m, window[:k - 1] + b + window[k:]) - score(m, window)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_positions_are_shared_by_tasks(spark, rows):
    """Sequences of one task are dealt out before their positions are grouped; short and repeated keys keep their rows."""
    import random
    r = random.Random(9)
    data = [(i % 40, "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 6, 9, 300])))) for i in range(120)]
    data += [(None, "ACGTACGT"), (None, "AC"), (1, None)]
    df = spark.createDataFrame(data, "id int, seq string").coalesce(1)
    for k in (2, 7):  # a model that every task has, and one that is joined by Spark's choice
        kmers = sorted({s[i:i + k] for _, s in data if s for i in range(len(s) - k + 1)})
        weight = {w: float(i % 7 - 3) for i, w in enumerate(kmers)}
        model = spark.createDataFrame(list(weight.items()), "kmer string, weight double")
        want, sums = [(i, 0.0) for i, s in data if s is not None and len(s) < k], {}
        for i, s in data:
            for p in range(len(s or "") - k + 1):
                sums[i] = sums.get(i, 0.0) + weight[s[p:p + k]]
        out = se.kmer_score(df, model, k)
        assert rows(out, "id", "score") == sorted(want + list(sums.items()), key=repr)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and plan.count("FileScan") + plan.count("Scan ExistingRDD") == 2
    tasks = se.windows(df, ["id"], "seq", 2, spread=True).select(F.spark_partition_id()).distinct().count()
    assert tasks > 1
    long = df.filter("char_length(seq) > 2")
    plan = se.delta_kmer_score(long, model.filter("false"), 2, missing="zero")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.rindex("partial_sum"):]


@pytest.mark.parametrize("pieces, at_once", [((1 << 16, 1 << 12), 1 << 22), ((16, 4), 100), ((7, 1), 1)])
def test_counted_kmers_equal_windows(spark, monkeypatch, rows, pieces, at_once):
    """Letters of one to four bytes and stray bytes, null and repeated keys, short and empty texts."""
    import random
    r = random.Random(5)
    data = [(r.choice([None, 1, 2, 3]), "".join(r.choice("ACGTacN é漢😀") for _ in range(r.choice([0, 1, 2, 3, 30])))) for _ in range(60)]
    df = (spark.createDataFrame([*data, (4, None), (5, "")], "id int, seq string")
          .union(spark.sql("select 6, cast(x'4143FF4754' as string)")).coalesce(2))
    for k in (1, 3, 7):
        want = se.windows(df, ["id"], "seq", k, short=True).groupBy("id", "window").agg(F.count(F.lit(1)).alias("n"))
        monkeypatch.setattr(se, "COUNTED", pieces)
        monkeypatch.setattr(se, "AT_ONCE", at_once)
        got = se.kmer_counts(df, ["id"], "seq", k).groupBy("id", "window").agg(F.sum("n").alias("n"))
        assert rows(got, "id", F.hex("window"), "n") == rows(want, "id", F.hex("window"), "n")
    assert set(rows(se.kmer_counts(df.filter("seq = ''"), ["id"], "seq", 2), "window", "n")) == {(None, 1)}


def test_no_row_for_each_position(spark, tmp_path, rows):
    """A piece of a sequence becomes a row for each different k-mer, not one for each position."""
    df = spark.createDataFrame([(1, "ACGT" * 1000), (2, "AC")], "id int, seq string")
    assert rows(se.kmer_counts(df, ["id"], "seq", 3), "id", "window", "n") == sorted(
        [(1, "ACG", 1000), (1, "CGT", 1000), (1, "GTA", 999), (1, "TAC", 999), (2, None, 1)], key=repr)
    model = spark.createDataFrame([("ACG", 2.0), ("CGT", 0.5), ("GTA", 0.0), ("TAC", -1.0)], "kmer string, weight double")
    out = se.kmer_score(df, model, 3)
    assert rows(out, "id", "score") == [(1, 1501.0), (2, 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("REPARTITION_BY_NUM")]
    assert "MapInArrow" in above and above.count("Generate explode") == 1  # the scores of equal keys
    from checks import sequence_checks as sc
    part = spark.createDataFrame([(1, "ab", "cd", "a"), (2, "abcd", "", "a"), (3, "a", "", "")],
                                 "p_partkey bigint, p_name string, p_type string, p_brand string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    weights = sc.model(spark, str(tmp_path))
    assert rows(weights) == [("ACG", 2.0), ("CGT", 2.0), ("GTA", 2.0)]
    assert "REPARTITION_BY_NUM" in weights._jdf.queryExecution().executedPlan().toString()


def test_raw_preds_travel_once(spark, tmp_path, rows):
    """Elements and bins of differing lengths keep their ends; rows are written where they were compared."""
    data = [("chr1:10-30", "chr1:12-40", 5, "A", "A", 2.0), ("chr1:10-30", "chr1:12-40", 5, "A", "C", 3.0),
            ("chr1:10-31", "chr1:12-40", 5, "A", "C", 7.0), ("chr2:10-30", "chr1:12-41", 5, "A", "A", 1.0),
            ("chr2:10-30", "chr1:12-41", 5, "A", "G", 1.5)]
    source = put(f"{tmp_path}/raw.tsv", *[(c, b, f"pos={p}", f"ref={r}", a, v) for c, b, p, r, a, v in data])
    got = rows(rd.read_allele_preds_raw(spark, source, None), "cre_chrom", "cre_end", "bin_end", "allele", "FC_to_ref")
    assert got == sorted([("chr1", 30, 40, "A", 0.0), ("chr1", 30, 40, "C", 1.0), ("chr1", 31, 40, "C", None),
                          ("chr2", 30, 41, "A", 0.0), ("chr2", 30, 41, "G", 0.5)], key=repr)
    plan = rd.read_allele_preds_raw(spark, source)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rd.ingest_allele_preds(spark, source, f"{tmp_path}/raw", form="raw")
    assert rows(tb.read_table(spark, f"{tmp_path}/raw"), "chrom", "cre_end", "bin_end", "log2FC") == [
        ("chr1", 30, 40, 1.0), ("chr1", 31, 40, None), ("chr2", 30, 41, 0.5)]
    df = spark.range(1000).selectExpr("id", "id % 2 as chrom").repartition(4, "id")
    tb.write_table(df, f"{tmp_path}/stay", ["chrom"], stay=True)
    files = [f for _, _, names in os.walk(f"{tmp_path}/stay") for f in names if f.endswith(".parquet")]
    assert len(files) == 8 and tb.read_table(spark, f"{tmp_path}/stay").count() == 1000


def test_prediction_files_are_small(spark, tmp_path, monkeypatch):
    """The text that the checks write is compressed, in parts of bounded length."""
    from checks import sequence_checks as sc
    monkeypatch.setattr(sc, "PART_ROWS", 10)
    p = spark.createDataFrame([("chr1", 10 * i, i, "A", "C", 0.5) for i in range(40)],
                              "chrom string, s bigint, pos bigint, ref_allele string, allele string, v double").coalesce(1)
    sc.write_raw(p, f"{tmp_path}/raw")
    tb.export_delimited(p, f"{tmp_path}/csv", gzip=True, most_rows=sc.PART_ROWS)
    for name, most in (("raw", 10), ("csv", 11)):  # a line for the header
        parts = [f for f in os.listdir(f"{tmp_path}/{name}") if f.startswith("part-")]
        assert len(parts) == 4 and all(f.endswith(".gz") for f in parts)
        assert all(gzip.open(f"{tmp_path}/{name}/{f}").read().count(b"\n") == most for f in parts)


def test_raw_preds_are_sorted_by_tasks_that_follow_the_input(spark, tmp_path, rows):
    """More shuffle tasks than there are partitions by default, still one shuffle, the same rows."""
    for i in range(3):
        put(f"{tmp_path}/raw/{i}.tsv", *[(f"chr1:{p}-30", "chr1:1-40", f"pos={p}", "ref=A", a, float(p + i * (a != "A")))
                                         for p in range(20) for a in "AC"])
    want = sorted((("chr1", p, a, float(i * (a != "A"))) for p in range(20) for a in "AC" for i in range(3)), key=repr)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        df = rd.read_allele_preds_raw(spark, f"{tmp_path}/raw", None)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
        assert rd.sorting_tasks(spark.read.text(f"{tmp_path}/raw")) == 24
        assert rows(df, "cre_chrom", "allele_pos", "allele", "FC_to_ref") == want
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_processed_preds_do_not_travel(spark, tmp_path, rows):
    """Each reading task writes its rows: a file for each of two input files in each chromosome."""
    for i in range(2):
        put(f"{tmp_path}/spdi/{i}.tsv", ("cre_chrom", "cre_start", "cre_end", "SPDI", "effect"),
            *[(f"chr{c}", 10, 20, f"NC:{p}:A:C", i + 0.5) for p in range(5) for c in (1, 2)])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        rd.ingest_allele_preds(spark, f"{tmp_path}/spdi", f"{tmp_path}/table")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    files = [f for _, _, names in os.walk(f"{tmp_path}/table") for f in names if f.endswith(".parquet")]
    assert len(files) == 4
    assert rows(tb.read_table(spark, f"{tmp_path}/table"), "chrom", "allele_pos", "log2FC") == sorted(
        ((f"chr{c}", p, i + 0.5) for p in range(5) for c in (1, 2) for i in range(2)), key=repr)
