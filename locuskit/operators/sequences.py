"""Sequences, k-mer models and saturation mutagenesis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from locuskit.operators.joins import skew_join
from locuskit.session import growing_tasks

# Sizes of pieces: a substring costs time in its offset, so long sequences are cut
# three times before single positions are taken
PIECES = (1 << 16, 1 << 8, 1 << 4)
#: Pieces whose k-mers are counted at once: they are cut no further, and most k-mers come up again within one.
COUNTED = (1 << 16, 1 << 12)
#: Bytes of k-mers that a task counts at a time.
AT_ONCE = 1 << 22
BASES = ("A", "C", "G", "T")
#: A model of k-mers up to this length is sent to all tasks: five letters give at most 15,625.
SHORT = 6


def assemble_sequences(df: DataFrame, keys: Sequence[str] = ("region",), pos: str = "allele_pos",
                       ref: str = "ref_allele", out: str = "seq") -> DataFrame:
    """Distinct reference letters in position order, gaps closed, conflicts both kept.

    Letters are joined within stretches of positions first; a sequence then gathers one
    text per stretch.
    """
    stretch = F.floor(F.col(pos) / PIECES[0])
    letters = F.sort_array(F.collect_set(F.struct(F.col(pos).alias("p"), F.col(ref).alias("r"))))
    pieces = (df.groupBy(*keys, stretch.alias("_s")).agg(letters.alias("_l"))
              .withColumn("_t", F.array_join(F.transform("_l", lambda x: x["r"]), "")))
    whole = F.sort_array(F.collect_list(F.struct("_s", "_t")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(whole, lambda x: x["_t"]), "").alias(out))


def _once(text: Column) -> Column:
    """The text as a generated column: worked out once for a row, not wherever it is used."""
    return F.explode(F.array(text))


def _whole(seqs: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return seqs.select(*keys, F.lit(0).cast("bigint").alias("_at"), _once(F.col(seq)).alias("_s"))


def _cut(rows: DataFrame, keys: Sequence[str], size: int, length: int, short: bool) -> DataFrame:
    """Pieces of ``size`` letters of each text, long enough at their ends to share no window but lose none."""
    last = F.greatest(F.floor((F.char_length("_s") - length) / size), F.lit(0))
    return (rows.filter(F.char_length("_s") >= (0 if short else length))
            .select(*keys, "_at", "_s", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
            .select(*keys, (F.col("_at") + F.col("_i") * size).alias("_at"),
                    _once(F.substring("_s", (F.col("_i") * size + 1).cast("int"),
                                      F.lit(size + length - 1))).alias("_s")))


def windows(seqs: DataFrame, keys: Sequence[str], seq: str, length: int, spread: bool = False,
            short: bool = False) -> DataFrame:
    """(keys, pos, window): every substring of ``length`` letters, pos from 0.

    With ``short`` a sequence of fewer letters has one row without a window. With ``spread`` the
    pieces of 256 letters are dealt to ``session.SPREAD`` tasks for each shuffle partition: a file of
    sequences is small next to its positions, and few tasks would hold what is grouped by position.
    """
    rows = _whole(seqs, keys, seq)
    for size in PIECES:
        if spread and size == PIECES[-1]:
            rows = rows.repartition(growing_tasks(seqs), *keys, "_at", "_s")
        rows = _cut(rows, keys, size, length, short)
    last, window = F.char_length("_s") - length, F.substring("_s", F.col("_i") + 1, F.lit(length))
    if short:
        last, window = F.greatest(last, F.lit(0)), F.when(F.char_length("_s") >= length, window)
    return (rows.select(*keys, "_at", "_s", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
            .select(*keys, (F.col("_at") + F.col("_i")).alias("pos"), window.alias("window")))


def _ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 that are equal where the values are, and how many there are."""
    top = int(values.max(initial=0)) + 1
    if top > 4 * len(values) + (1 << 21):
        distinct, ranks = np.unique(values, return_inverse=True)
        return ranks, len(distinct)
    seen = np.zeros(top, bool)
    seen[values] = True
    ranks = np.cumsum(seen) - 1
    return ranks[values], int(ranks[-1]) + 1


def _count(texts: list[bytes], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text number, k-mer, how often it is in that text); a text of fewer letters has one without a k-mer."""
    texts = [t.decode("utf-8", "surrogateescape") for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    letters, base = _ranks(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = max(len(whole) - k + 1, 0)
    codes, span = letters[:ends], base
    for i in range(1, k):
        codes, span = _ranks(codes * base + letters[i:i + ends])
    starts = np.flatnonzero(text[:ends] == text[k - 1:k - 1 + ends])
    found, n = np.unique(text[starts] * span + codes[starts], return_counts=True)
    place = np.full(span, -1)
    place[codes[starts]] = starts
    kmers = pa.array([whole[i:i + k].encode("utf-8", "surrogateescape") if i >= 0 else None for i in place.tolist()], pa.binary())
    short = np.flatnonzero(lengths < k)
    return (np.concatenate([found // max(span, 1), short]),
            pa.concat_arrays([kmers.take(pa.array(found % max(span, 1))), pa.nulls(len(short), pa.binary())]),
            np.concatenate([n, np.ones(len(short), np.int64)]))


def kmer_counts(seqs: DataFrame, keys: Sequence[str], seq: str, k: int) -> DataFrame:
    """(keys, window, n): how often each k-mer is in a piece of a sequence, so rows of the same k-mer may follow.

    A sequence of fewer letters has one row without a window. Pieces are dealt to ``session.SPREAD`` tasks
    for each shuffle partition, and are counted there without a row for each position.
    """
    rows = _whole(seqs, keys, seq)
    for size in COUNTED:
        rows = _cut(rows, keys, size, k, True)
    rows = rows.repartition(growing_tasks(seqs), *keys, "_at", "_s")
    shape = rows.select(*keys).schema.add("window", BinaryType()).add("n", LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends * (k + 5) // AT_ONCE)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
                some, kmers, n = _count(texts.slice(lo, hi - lo).to_pylist(), k)
                spots = pa.array(some + lo)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(spots) for c in batch.columns[:-1]], kmers, pa.array(n)], names=shape.names)

    return (rows.select(*keys, F.col("_s").cast("binary")).mapInArrow(count, shape)
            .withColumn("window", F.col("window").cast("string")))


def kmer_length(weights: DataFrame) -> int:
    """Length of the model's k-mers (runs one aggregate)."""
    found = weights.agg(F.min(F.char_length("kmer")).alias("lo"),
                        F.max(F.char_length("kmer")).alias("hi")).first()
    if found["lo"] is None or found["lo"] != found["hi"]:
        raise ValueError("the model needs k-mers of one length")
    return found["lo"]


def _weight(column: Column, kmer: Column, missing: str) -> Column:
    if missing == "zero":
        return F.coalesce(column, F.lit(0.0))
    if missing != "error":
        raise ValueError("missing is 'error' or 'zero'")
    return F.coalesce(column, F.raise_error(F.concat(F.lit("k-mer without weight: "), kmer))
                      .cast("double"))


def kmer_score(seqs: DataFrame, weights: DataFrame, k: int, keys: Sequence[str] = ("id",),
               seq: str = "seq", missing: str = "error") -> DataFrame:
    """Sum of the weights of all k-mers per sequence; one shorter than k scores 0.

    Equal k-mers of a piece are counted before they meet the model, those of a whole sequence but
    for a model of short ones, which every task has.
    """
    counts = kmer_counts(seqs, keys, seq, k)
    model = weights.select(F.col("kmer").alias("window"), F.col("weight").alias("_w"))
    if k <= SHORT:
        model = F.broadcast(model)
    else:
        counts = counts.groupBy(*keys, "window").agg(F.sum("n").alias("n"))
    none = F.col("window").isNull()
    weight = F.when(none, 0.0).otherwise(_weight(F.col("_w"), F.col("window"), missing))
    sums = (counts.join(model, "window", "left").groupBy(*keys)
            .agg(F.sum(F.col("n") * weight).alias("_sum"), F.count("window").alias("_long"),
                 F.sum(F.when(none, F.col("n")).otherwise(0)).alias("_short")))
    # a row for all sequences of the keys that have k-mers, and one for each that has none
    scores = F.concat(F.array_repeat("_sum", (F.col("_long") > 0).cast("int")),
                      F.array_repeat(F.lit(0.0), F.col("_short").cast("int")))
    return sums.select(*keys, F.explode(scores).alias("score"))


def _alternatives(ref: Column) -> Column:
    return F.array_remove(F.array(*[F.lit(b) for b in BASES]), ref)


def saturation_variants(seqs: DataFrame, keys: Sequence[str] = ("id",), seq: str = "seq") -> DataFrame:
    """Every position with each of the other bases; lower-case or unknown letters get four."""
    return (windows(seqs, keys, seq, 1)
            .select(*keys, "pos", F.col("window").alias("ref"),
                    F.explode(_alternatives(F.col("window"))).alias("alt")))


#: Letters of packed k-mers by digit; any other letter is digit 5 and has no weight.
LETTERS = "ACGTN"
DIGITS = len(LETTERS) + 1
#: The longest k-mer whose code fits into 63 bits.
LONGEST = 24


def packed(kmer: Column) -> Column:
    """A k-mer of up to ``LONGEST`` letters as a number, a digit per letter, the first one highest."""
    digits = F.translate(F.regexp_replace(kmer, f"[^{LETTERS}]", "x"), LETTERS + "x", "012345")
    return F.conv(digits, DIGITS, 10).cast("bigint")


def _unpacked(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, DIGITS), k, "0"), "012345", LETTERS + "?")


def _packed_weight(column: Column, code: Column, k: int, missing: str) -> Column:
    return _weight(column, _unpacked(code, k), missing)


def delta_kmer_score(seqs: DataFrame, weights: DataFrame, k: int, keys: Sequence[str] = ("id",),
                     seq: str = "seq", start: str | None = None, missing: str = "error",
                     model: Sequence[str] = ()) -> DataFrame:
    """Change of the k-mer score for every base change with k - 1 letters on both sides.

    Every k-mer of a sequence is packed into a number and looks up its own weight once. Its 3k
    changed forms are sums on that number, so they look up theirs without a text being cut;
    the differences are summed by changed position, each base in a column of its own, in tasks
    that share the positions evenly. ``model`` names columns of both
    tables, so one call scores sequences of many models. ``start`` names a column with the
    coordinate of the first letter. Letters but A, C, G, T and N have no weight, k may be up to
    ``LONGEST``, and a sequence shorter than 2k - 1 is an error.
    """
    wide = 2 * k - 1
    if k > LONGEST:
        raise ValueError(f"k-mers of at most {LONGEST} letters can be packed")
    kept = [*keys, *[m for m in model if m not in keys], *([start] if start else [])]
    checked = seqs.withColumn(seq, F.when(F.char_length(seq) >= wide, F.col(seq)).otherwise(
        F.raise_error(F.lit(f"sequence length must be at least {wide} characters"))))
    checked = checked.withColumn("_last", F.char_length(seq) - k)
    table = weights.filter(F.col("kmer").rlike(f"^[{LETTERS}]+$")).select(
        *model, packed(F.col("kmer")).alias("_code"), F.col("weight").alias("_w"))
    if k <= SHORT:
        table = F.broadcast(table)
    rows = windows(checked, [*kept, "_last"], seq, k, spread=True).withColumn("_code", packed(F.col("window")))
    old = (rows.join(table, [*model, "_code"], "left")
           .withColumn("_old", _packed_weight(F.col("_w"), F.col("_code"), k, missing)).drop("_w"))
    place = F.struct(F.col("_o"), F.substring("window", F.col("_o") + 1, F.lit(1)).alias("ref"),
                     F.element_at(F.array(*[F.lit(DIGITS ** (k - 1 - o)).cast("bigint") for o in range(k)]),
                                  F.col("_o") + 1).alias("unit"))
    spots = (old.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
             .withColumn("pos", F.col("pos") + F.col("_o")).filter(F.col("pos").between(k - 1, F.col("_last")))
             .withColumn("_s", place).select(*kept, "pos", "_old", "_code", "_s.ref", "_s.unit"))
    digit = F.expr(f"(_code div unit) % {DIGITS}")
    bases = F.array(*[F.struct(F.lit(b).alias("alt"), F.lit(i).alias("d")) for i, b in enumerate(BASES)])
    changed = (spots.withColumn("_d", digit).withColumn("_b", F.explode(F.filter(bases, lambda x: x["alt"] != F.col("ref"))))
               .select(*kept, "pos", "_old", "ref", F.col("_b.alt").alias("alt"),
                       (F.col("_code") + (F.col("_b.d") - F.col("_d")) * F.col("unit")).alias("_code")))
    new = changed.join(table, [*model, "_code"], "left")
    change = _packed_weight(F.col("_w"), F.col("_code"), k, missing) - F.col("_old")
    offset = F.col(start) if start else F.lit(0)
    sums = new.groupBy(*kept, "pos", "ref").agg(*[F.sum(F.when(F.col("alt") == b, change)).alias(f"_{b}") for b in BASES])
    scores = F.array(*[F.struct(F.lit(b).alias("alt"), F.col(f"_{b}").alias("score")) for b in BASES])
    return (sums.withColumn("_c", F.explode(F.filter(scores, lambda x: x["alt"] != F.col("ref"))))
            .select(*keys, (F.col("pos") + offset).alias("pos"), "ref", "_c.alt", "_c.score"))


def region_sequences(regions: DataFrame, chunks: DataFrame, chunk_size: int, lo: Column, hi: Column,
                     keys: Sequence[str], out: str = "seq") -> DataFrame:
    """Upper-case reference sequence of [lo, hi) per region from a chunked genome table.

    ``chunks`` holds (chrom, chunk_start, sequence), each chunk_start a multiple of
    ``chunk_size``; a region asks for just the chunks it touches.
    """
    spans = regions.select(*keys, "chrom", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
    asked = spans.withColumn("chunk_start", F.explode(F.sequence(
        F.floor(F.col("_lo") / chunk_size) * chunk_size,
        F.floor((F.col("_hi") - 1) / chunk_size) * chunk_size, F.lit(chunk_size).cast("bigint"))))
    met = skew_join(asked, chunks.select("chrom", "chunk_start", "sequence"), ["chrom", "chunk_start"])
    at = F.col("l.chunk_start")
    begin = F.greatest(F.col("l._lo") - at, F.lit(0))
    end = F.least(F.col("l._hi") - at, F.lit(chunk_size))
    names = [*keys, *(["chrom"] if "chrom" not in keys else []), "_lo"]
    piece = F.substring("r.sequence", (begin + 1).cast("int"), (end - begin).cast("int"))
    parts = met.select(*[F.col(f"l.{c}").alias(c) for c in names], at.alias("_c"), piece.alias("_p"))
    ordered = F.sort_array(F.collect_list(F.struct("_c", "_p")))
    return (parts.groupBy(*names).agg(
        F.upper(F.array_join(F.transform(ordered, lambda x: x["_p"]), "")).alias(out))
        .withColumnRenamed("_lo", "seq_start"))


def score_regions(regions: DataFrame, chunks: DataFrame, chunk_size: int,
                  models: dict[str, tuple[DataFrame, int]], missing: str = "error") -> DataFrame:
    """Score changes at every position of each region with the model of its region type.

    ``models`` maps a region type to (weights, k). Regions are inclusive and are widened by
    k - 1 on both sides so that their first and last bases are scored too. All models of one
    k-mer length are one table, and all their regions one plan.
    """
    out = None
    for k in sorted({k for _, k in models.values()}):
        tables = [w.select(F.lit(t).alias("region_type"), "kmer", "weight") for t, (w, n) in models.items() if n == k]
        weights = reduce(lambda a, b: a.unionByName(b), tables)
        part = regions.filter(F.col("region_type").isin([t for t, (_, n) in models.items() if n == k]))
        seqs = region_sequences(part, chunks, chunk_size, F.col("start_pos") - (k - 1),
                                F.col("end_pos") + k, ["region", "chrom", "region_type"])
        scored = (delta_kmer_score(seqs, weights, k, ["region", "chrom"], "seq", "seq_start", missing, ["region_type"])
                  .select("region", "chrom", F.col("pos").alias("allele_pos"),
                          F.col("ref").alias("ref_allele"), F.col("alt").alias("alt_allele"),
                          F.col("score").alias("log2FC")))
        out = scored if out is None else out.unionByName(scored)
    return out
