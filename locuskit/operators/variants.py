"""Predicted and measured variant effects: joins, labels, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import log2_or_null, ratio, row_mean, row_min, single_base
from locuskit.session import growing_tasks

PLACE = ["chrom", "allele_pos", "alt_allele"]
POSITION = ("cre_chrom", "cre_start", "cre_end", "bin_chrom", "bin_start", "bin_end", "allele_pos")
VARIANT = ["region_type", "region", "chrom", "allele_pos", "ref_allele", "alt_allele"]


def keep_single_base(df: DataFrame, ref: str = "ref_allele", alt: str = "alt_allele") -> DataFrame:
    return df.filter(single_base(F.col(ref), F.col(alt)))


def max_abs_measurement(mpra: DataFrame, keys: Sequence[str] = VARIANT) -> DataFrame:
    """Per variant the measurement of largest |Value|; experiment, then value settle ties."""
    best = F.max_by(F.struct("Value", "p_value", "Tags", "experiment"),
                    F.struct(F.abs("Value").alias("a"), F.col("experiment").alias("b"),
                             F.col("Value").alias("c"), F.col("p_value").alias("d"),
                             F.col("Tags").alias("e")))
    return (mpra.groupBy(*keys).agg(best.alias("_m"))
            .select(*keys, F.col("_m.Value").alias("mpra_max_log2effect"),
                    F.col("_m.p_value").alias("mpra_p_value"), F.col("_m.Tags").alias("mpra_tags"),
                    F.col("_m.experiment").alias("mpra_experiment")))


def join_preds_to_mpra(preds: DataFrame, mpra: DataFrame, alt_col: str = "alt_allele",
                       agg: str = "first", keep_pred_rows: bool = False) -> DataFrame:
    """Predictions for measured variants by chromosome, position and alternative allele.

    The reference allele is reported from both sides but is no key. Both sides are
    aggregated to the key before they meet, so repeated measurements or predictions of one
    variant are never multiplied. ``agg`` reduces several predictions of a variant to the
    ``first`` (smallest ref, value), the ``mean``, or the one of largest magnitude
    (``max_abs``); ``keep_pred_rows`` keeps every distinct (ref, value) instead.
    """
    slim = preds.select("chrom", "allele_pos", F.col(alt_col).alias("alt_allele"),
                        F.col("ref_allele").alias("pred_ref_allele"), F.col("log2FC"))
    if keep_pred_rows:
        reduced = slim.distinct()
    elif agg == "mean":
        reduced = slim.groupBy(*PLACE).agg(F.min("pred_ref_allele").alias("pred_ref_allele"),
                                           F.avg("log2FC").alias("log2FC"))
    elif agg in ("first", "max_abs"):
        order = F.struct("pred_ref_allele", "log2FC") if agg == "first" else F.struct(
            -F.abs("log2FC"), "pred_ref_allele", "log2FC")
        reduced = (slim.groupBy(*PLACE)
                   .agg(F.min_by(F.struct("pred_ref_allele", "log2FC"), order).alias("_p"))
                   .select(*PLACE, "_p.pred_ref_allele", "_p.log2FC"))
    else:
        raise ValueError(f"unknown agg {agg!r}")
    return (max_abs_measurement(mpra).join(reduced, PLACE)
            .select("region_type", "region", "chrom", "allele_pos", "ref_allele", "pred_ref_allele",
                    "alt_allele", "log2FC", "mpra_max_log2effect", "mpra_p_value", "mpra_tags",
                    "mpra_experiment"))


def calls_preds_counts(calls: DataFrame, preds: DataFrame, counts: DataFrame) -> DataFrame:
    """Bayesian calls, predictions and replicate counts of the same variants."""
    p = preds.select("chrom", "allele_pos", F.col("allele").alias("alt_allele"),
                     F.col("ref_allele").alias("pred_ref_allele"), "log2FC")
    c = counts.select(*PLACE, "avg_input_ref", "min_avg_count")
    return (calls.join(p, PLACE).join(c, PLACE)
            .select("chrom", "allele_pos", "ref_allele", "alt_allele", "theta", "lowerCI", "upperCI",
                    "P_reg", "pred_ref_allele", "log2FC", "avg_input_ref", "min_avg_count"))


def with_coordinates(regions: DataFrame, rel: DataFrame) -> DataFrame:
    """Relative predictions placed on the chromosome by region name."""
    r = regions.select("region", "region_type", "chrom", "start_pos")
    return (rel.drop("region_type").join(r, "region")
            .select("chrom", "region_type", "region",
                    (F.col("start_pos") + F.col("rel_pos")).alias("allele_pos"), "ref_allele",
                    "alt_allele", F.col("log2fc").alias("log2FC"), "cell_line", "experiment"))


def class_labels(p_pos: float, p_neg: float | None = None) -> tuple[str, str]:
    """Default label texts."""
    return f"MPRA p≤{p_pos}", f"MPRA p>{p_pos if p_neg is None else p_neg}"


def add_class_labels(df: DataFrame, p_pos: float, p_neg: float | None = None,
                     abs_effect: float = 0.05, pos_label: str | None = None,
                     neg_label: str | None = None, min_tags: int = 10, label: str = "label",
                     strict: bool = False) -> DataFrame:
    """Add the class; a row that fits both is negative, one that fits none is NULL.

    ``strict`` asks for p < p_pos instead of p <= p_pos.
    """
    defaults = class_labels(p_pos, p_neg)
    p, tagged = F.col("mpra_p_value"), F.col("mpra_tags") >= min_tags
    limit = p_pos if p_neg is None else p_neg
    negative = (p > limit) & (F.abs("mpra_max_log2effect") < abs_effect) & tagged
    positive = ((p < p_pos) if strict else (p <= p_pos)) & tagged
    return df.withColumn(label, F.when(negative, F.lit(neg_label or defaults[1]))
                         .when(positive, F.lit(pos_label or defaults[0])))


def add_posterior_labels(df: DataFrame, pos: float = 0.9, neg: float = 0.3,
                         pos_label: str | None = None, neg_label: str | None = None,
                         prob: str = "P_reg", label: str = "label") -> DataFrame:
    """Class by posterior probability of a regulatory effect."""
    p = F.col(prob)
    return df.withColumn(label, F.when(p <= neg, F.lit(neg_label or f"{prob} ≤ {neg}"))
                         .when(p >= pos, F.lit(pos_label or f"{prob} ≥ {pos}")))


def add_direction(df: DataFrame, effect: str = "mpra_max_log2effect", neutral: float = 0.0,
                  pred: str = "log2FC", zero_is_up: bool = True) -> DataFrame:
    """Add ``direction`` ('up', 'down') of the measured effect and ``abs_<pred>``.

    With ``zero_is_up=False`` a neutral effect has no direction, as for ratios around 1.
    """
    e = F.col(effect)
    up = e >= neutral if zero_is_up else e > neutral
    return (df.withColumn("direction", F.when(up, F.lit("up")).when(e < neutral, F.lit("down")))
            .withColumn(f"abs_{pred}", F.abs(pred)))


def class_subset(df: DataFrame, min_avg: float, only_class: str | None = None,
                 other_class: str | None = None, avg: str = "avg_input_ref",
                 label: str = "label") -> DataFrame:
    """Rows with enough input reads; with ``only_class`` just that class is thinned."""
    enough = F.col(avg) >= min_avg
    if only_class is None:
        return df.filter(enough)
    return df.filter((enough & (F.col(label) == only_class)) | (F.col(label) == other_class))


def exclude(df: DataFrame, **values: object) -> DataFrame:
    """Drop rows in which every named column has the given value; NULL never matches."""
    hit = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
    return df.filter(~hit)


def ref_mismatches(df: DataFrame, ref: str = "ref_allele", pred_ref: str = "pred_ref_allele") -> DataFrame:
    return df.filter(F.col(ref) != F.col(pred_ref))


def mismatch_counts(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows, compared rows and mismatches per model; a NULL allele on either side compares nothing."""
    differs = F.col("ref_allele") != F.col("pred_ref_allele")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count(differs).alias("compared"),
                               F.count_if(differs).alias("mismatches"))


def mismatch_positions(df: DataFrame, split: int = 5) -> DataFrame:
    """Mismatching positions per region, marked as few (<= split) or many."""
    return (ref_mismatches(df).groupBy("region_type", "region")
            .agg(F.count_distinct("allele_pos").alias("num_mismatches"))
            .withColumn("many", F.col("num_mismatches") > split))


def drop_mismatches(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ref_allele") == F.col("pred_ref_allele"))


def relative_to_reference(df: DataFrame, effect: str = "log2FC", out: str = "FC_to_ref",
                          keys: Sequence[str] = POSITION) -> DataFrame:
    """Effect minus the effect of the reference allele at the same position.

    One shuffle and one read: the position's rows, one for each allele and copy of it, are
    put side by side. Positions without a reference row get NULL.
    """
    ref = F.max(F.when(F.col("allele") == F.col("ref_allele"), F.col(effect))).over(W.partitionBy(*keys))
    return df.select(*df.columns, (F.col(effect) - ref).alias(out))


def allele_profile(df: DataFrame, chrom: str, start: int, with_reference: bool = True) -> DataFrame:
    """Predictions of one element."""
    rows = df.filter((F.col("cre_chrom") == chrom) & (F.col("cre_start") == start))
    return rows if with_reference else rows.filter(F.col("allele") != F.col("ref_allele"))


def count_averages(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Mean count per replicate group, the smallest of them, and the ratio of ratios.

    ``groups`` needs the keys input_ref, input_alt, output_ref and output_alt.
    """
    out = df
    for name, columns in groups.items():
        out = out.withColumn(f"avg_{name}", row_mean([F.col(c) for c in columns]))
    return (out.withColumn("min_avg_count", row_min([F.col(f"avg_{g}") for g in groups]))
            .withColumn("naive_theta", effect_ratio()))


def effect_ratio(prefix: str = "avg_") -> Column:
    """(output alt / output ref) / (input alt / input ref); NULL where undefined."""
    return ratio(ratio(F.col(f"{prefix}output_alt"), F.col(f"{prefix}output_ref")),
                 ratio(F.col(f"{prefix}input_alt"), F.col(f"{prefix}input_ref")))


def theta_report(joined: DataFrame, counts: DataFrame, count_columns: Sequence[str],
                 neg: float = 0.3, min_input: float = 30, min_count: float = 5) -> DataFrame:
    """Calls with enough reads next to their counts, strongest first."""
    side = counts.select(*PLACE, "naive_theta", F.col("min_avg_count").alias("_min"), *count_columns)
    keep = (F.col("P_reg") > neg) | ((F.col("P_reg") <= neg) & (F.col("avg_input_ref") >= min_input))
    return (joined.filter(keep).join(side.filter(F.col("_min") >= min_count), PLACE)
            .select("chrom", F.col("allele_pos").alias("pos"), F.col("ref_allele").alias("ref"),
                    F.col("alt_allele").alias("alt"), F.col("log2FC").alias("pred_log2FC"),
                    log2_or_null(F.col("theta")).alias("log2_theta"),
                    log2_or_null(F.col("naive_theta")).alias("log2_naive_theta"), "P_reg",
                    *count_columns)
            .orderBy(F.desc("P_reg"), F.desc(F.abs("log2_theta"))))


def report_tail(report: DataFrame, above: float | None = None, below: float | None = None) -> DataFrame:
    """The sure positives in report order, or the sure negatives in reverse order."""
    if above is not None:
        return report.filter(F.col("P_reg") > above)
    return (report.filter(F.col("P_reg") < below)
            .orderBy(F.asc("P_reg"), F.asc(F.abs("log2_theta"))))


def check_predictions(preds: DataFrame) -> DataFrame:
    """Violations of the assumptions about prediction tables: (rule, chrom, start, end, detail).

    Every row says once what it means for each rule. Equal statements are counted in the task
    that makes them, so what is shuffled is distinct (rule, group, value), and a second sum gives
    the number of values of each group: one read and two shuffles for all rules together. A rule
    about single rows reports each of them, a rule about groups each group. The rows are dealt out
    first, as a task of the scan would hold several statements for each of its many rows; rules go
    by number, and what follows from a group's bounds is worked out behind the shuffles.
    """
    cre, bin_ = ["cre_chrom", "cre_start", "cre_end"], ["bin_chrom", "bin_start", "bin_end"]
    cre_len, bin_len = F.col("cre_end") - F.col("cre_start"), F.col("bin_end") - F.col("bin_start")
    cre_mid = F.floor(F.col("cre_start") / 2 + F.col("cre_end") / 2)
    bin_mid = F.floor(F.col("bin_start") / 2 + F.col("bin_end") / 2)
    pos, none = F.col("allele_pos"), F.lit(None)

    rules = ("position_inside_bin", "bin_overlaps_element", "same_centre", "one_bin_per_element",
             "all_positions_of_element", "all_positions_of_bin", "four_alleles")
    singles = 3

    def said(rule: str, keys: Sequence[str], number: Column = none, letter: Column = none) -> Column:
        chrom, start, end = [F.col(k) for k in (*keys, keys[-1])[:3]]
        return F.struct(F.lit(rules.index(rule)).cast("byte").alias("rule"), chrom.alias("chrom"), start.alias("start"),
                        end.alias("end"), number.cast("bigint").alias("number"), letter.cast("string").alias("letter"))

    statements = F.array_compact(F.array(
        F.when((pos < F.col("bin_start")) | (pos >= F.col("bin_end")), said("position_inside_bin", cre, pos)),
        F.when((F.col("bin_chrom") != F.col("cre_chrom")) | (F.col("bin_start") >= F.col("cre_end"))
               | (F.col("bin_end") <= F.col("cre_start")), said("bin_overlaps_element", cre, F.col("bin_start"))),
        F.when(bin_mid != cre_mid, said("same_centre", cre, bin_mid - cre_mid)),
        said("one_bin_per_element", cre, F.col("bin_start")),
        F.when(cre_len < bin_len, said("all_positions_of_element", cre, pos)),
        F.when(cre_len >= bin_len, said("all_positions_of_bin", bin_, pos)),
        said("four_alleles", ["bin_chrom", "allele_pos"], letter=F.col("allele"))))
    used = preds.select(*cre, *bin_, "allele_pos", "allele").repartition(growing_tasks(preds))
    distinct = (used.select(F.explode(statements).alias("_s")).select("_s.*")
                .groupBy("rule", "chrom", "start", "end", "number", "letter").agg(F.count(F.lit(1)).alias("n")))
    single = (F.col("rule") < singles) & F.col("number").isNotNull()
    value = F.coalesce(F.col("letter"), F.when(F.col("rule") >= singles, F.col("number").cast("string")))
    counts = (distinct.groupBy("rule", "chrom", "start", "end", F.when(single, F.col("number")).alias("shown"))
              .agg(F.count(value).alias("detail"), F.sum("n").alias("n")))
    single, n, rule = F.col("shown").isNotNull(), F.col("detail"), F.col("rule")
    expected = F.when(rule == rules.index("four_alleles"), 4).otherwise(F.col("end") - F.col("start"))
    broken = F.when(rule == rules.index("one_bin_per_element"), n > 1).otherwise(n != expected)
    copies = F.when(single, F.col("n")).otherwise(1).cast("int")
    name = F.element_at(F.array(*[F.lit(r) for r in rules]), rule.cast("int") + 1)
    return (counts.filter(single | ((rule >= singles) & broken)).select(name.alias("rule"), "chrom", "start", "end", F.explode(
        F.array_repeat(F.coalesce("shown", n), copies)).alias("detail")))
