"""ROC curves, their area, cutoffs and top-N subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.operators.ordered import running_totals, take_first, take_first_each, with_group_values
from locuskit.operators.sampling import sample_rows

#: Largest n for which Spark limits the rows of a window's group before the shuffle (its default).
RANKED = 1000


def _class_counts(df: DataFrame, score: Column, label: str, pos: object, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct (group, score)."""
    rows = df.filter(F.col(label).isNotNull()).select(
        *by, score.cast("double").alias("score"), (F.col(label) == F.lit(pos)).alias("_pos"))
    return (rows.filter(F.col("score").isNotNull()).groupBy(*by, "score")
            .agg(F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg")))


def _as_score(score: str | Column) -> Column:
    return F.col(score) if isinstance(score, str) else score


def roc_points(df: DataFrame, score: str | Column, label: str, pos: object,
               by: Sequence[str] = (), origin: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) for every distinct score; a row counts when score >= threshold.

    ``origin`` adds the point (0, 0) with an infinite threshold per group. Rates are NULL
    for a group that lacks a class.
    """
    counts = _class_counts(df, _as_score(score), label, pos, by)
    cum = running_totals(counts, by, "score", ["pos", "neg"], descending=True)
    rate = lambda part, whole: F.try_divide(F.col(part), F.col(whole))
    points = cum.select(*by, rate("cum_neg", "all_neg").alias("fpr"),
                        rate("cum_pos", "all_pos").alias("tpr"), F.col("score").alias("threshold"))
    if not origin:
        return points
    zero = F.lit(0.0)
    starts = (counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
              .select(*by, zero.alias("fpr"), zero.alias("tpr"),
                      F.lit(float("inf")).alias("threshold")))
    return points.unionByName(starts)


def auroc(df: DataFrame, score: str | Column, label: str, pos: object,
          by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL if a class is missing."""
    counts = _class_counts(df, _as_score(score), label, pos, by)
    cum = running_totals(counts, by, "score", ["pos", "neg"], descending=True)
    below = F.col("all_neg") - F.col("cum_neg") + F.col("neg") / F.lit(2.0)
    return (cum.groupBy(*by)
            .agg(F.sum(F.col("pos") * below).alias("_won"), F.max("all_pos").alias("positives"),
                 F.max("all_neg").alias("negatives"))
            .select(*by, "positives", "negatives", F.try_divide(
                F.col("_won"), F.col("positives").cast("double") * F.col("negatives"))
                .alias("auroc")))


def youden_cutoff(df: DataFrame, score: str | Column, label: str, pos: object,
                  by: Sequence[str] = ()) -> DataFrame:
    """Threshold of largest tpr - fpr per group, the highest one on ties."""
    points = roc_points(df, score, label, pos, by)
    j = F.col("tpr") - F.col("fpr")
    return (points.groupBy(*by)
            .agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(j.alias("j"), "threshold"))
                 .alias("_b"))
            .select(*by, F.col("_b.threshold").alias("cutoff"), F.col("_b.tpr").alias("tpr"),
                    F.col("_b.fpr").alias("fpr")))


def _mcc(counts: DataFrame, called: Column, by: Sequence[str]) -> DataFrame:
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    sums = counts.groupBy(*by).agg(
        total(called, "pos").alias("tp"), total(called, "neg").alias("fp"),
        total(~called, "pos").alias("fn"), total(~called, "neg").alias("tn"))
    tp, fp, fn, tn = [F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return sums.withColumn("mcc", F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)))


def _called(score: Column, cutoff: Column, direction: str) -> Column:
    if direction not in ("ge", "le"):
        raise ValueError("direction is 'ge' or 'le'")
    return score >= cutoff if direction == "ge" else score <= cutoff


def mcc(df: DataFrame, score: str | Column, label: str, pos: object, cutoff: float,
        direction: str = "ge", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and phi coefficient at one cutoff; 0 where it is undefined."""
    counts = _class_counts(df, _as_score(score), label, pos, by)
    return _mcc(counts, _called(F.col("score"), F.lit(float(cutoff)), direction), by)


def mcc_at(df: DataFrame, score: str | Column, label: str, pos: object, cutoffs: DataFrame,
           by: Sequence[str], direction: str = "ge") -> DataFrame:
    """As :func:`mcc`, with one ``cutoff`` per group from a table."""
    counts = _class_counts(df, _as_score(score), label, pos, by)
    joined = with_group_values(counts, cutoffs, by, ["cutoff"])
    return _mcc(joined, _called(F.col("score"), F.col("cutoff"), direction), by)


def top_abs(df: DataFrame, n: int, effect: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The n rows of largest |effect|, per group if ``by`` is given; ``key`` settles ties.

    Up to ``RANKED`` rows per group Spark keeps n of them in each task before it shuffles, and one
    task ranks what is left of a group. Beyond, each group's cutoff value is found and its rows
    filtered in place, so that no task holds n rows of a hot group.
    """
    ranked = df.filter(F.col(effect).isNotNull()).withColumn("_down", -F.abs(effect))
    if not by:
        return take_first(ranked, n, ["_down", key]).drop("_down")
    if n > RANKED:
        return take_first_each(ranked, n, by, "_down", key).drop("_down")
    # the filter on the row number lets Spark keep n rows per group before it shuffles
    place = F.row_number().over(W.partitionBy(*by).orderBy("_down", key))
    return (ranked.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place", "_down"))


def top_abs_with_negatives(df: DataFrame, n: int, neg_label: object, key: str,
                           effect: str = "mpra_max_log2effect", label: str = "label",
                           seed: int = 42, exclude_top: bool = False) -> DataFrame:
    """The n strongest rows of any class, then n random rows of the negative class.

    A negative among the strongest may come up twice unless ``exclude_top``. Fewer than n
    negatives is an error.
    """
    top = top_abs(df, n, effect, key)
    negatives = df.filter(F.col(label) == F.lit(neg_label))
    if exclude_top:
        negatives = negatives.join(top.select(key), key, "left_anti")
    enough = negatives.agg(F.count(F.lit(1))).scalar() >= n
    checked = sample_rows(negatives, n, key, seed).filter(
        F.when(enough, True).otherwise(
            F.raise_error(F.lit(f"fewer than {n} negatives")).cast("boolean")))
    return top.unionByName(checked)


def auroc_top_n(df: DataFrame, neg_label: object, pos_label: object, key: str,
                ns: Sequence[int] = (1000, 500, 200), effect: str = "mpra_max_log2effect",
                score: str = "log2FC", label: str = "label", seed: int = 42,
                include_full: bool = True) -> DataFrame:
    """Area by |score| on all rows and on each top-N subset."""
    slim = df.select(*dict.fromkeys([key, effect, score, label]))
    parts = [slim.withColumn("subset", F.lit("All"))] if include_full else []
    parts += [top_abs_with_negatives(slim, n, neg_label, key, effect, label, seed)
              .withColumn("subset", F.lit(str(n))) for n in ns]
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part)
    return auroc(tagged, F.abs(score), label, pos_label, ["subset"])


def auroc_by_subset(df: DataFrame, score: str, label: str, pos: object, model: str,
                    levels: Sequence[str], named: Sequence[tuple[str, str]] = (),
                    all_name: str = "All data") -> DataFrame:
    """Area by |score| per model on all rows, on named values and on each value of each level."""
    entry = lambda level, value: F.struct(
        F.lit(level).alias("level"), value.cast("string").alias("subset"))
    subsets = [entry("all", F.lit(all_name))]
    subsets += [entry("named", F.when(F.col(c) == F.lit(v), F.lit(v))) for c, v in named]
    subsets += [entry(c, F.col(c)) for c in levels]
    rows = (df.withColumn("_s", F.explode(F.array(*subsets)))
            .select(model, F.col("_s.level").alias("level"), F.col("_s.subset").alias("subset"),
                    score, label).filter(F.col("subset").isNotNull()))
    return auroc(rows, F.abs(score), label, pos, [model, "level", "subset"])
