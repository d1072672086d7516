"""Predictions of several models against measurements, and against Bayesian calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.operators import metrics as me
from locuskit.operators import variants as va
from locuskit.operators.joins import infill, tagged_union


def matched_models(models: dict[str, DataFrame], mpra: DataFrame, alt_col: str = "allele") -> DataFrame:
    """Matched variants of every model, tagged by ``model``."""
    return tagged_union({name: va.join_preds_to_mpra(preds, mpra, alt_col)
                         for name, preds in models.items()}, "model")


def matched_with_infill(preds: DataFrame, more: DataFrame, mpra: DataFrame,
                        alt_col: str = "allele") -> DataFrame:
    """Matches of ``preds``, filled up with those of ``more`` where there are none."""
    first = va.join_preds_to_mpra(preds, mpra, alt_col, keep_pred_rows=True)
    second = va.join_preds_to_mpra(more, mpra, alt_col, keep_pred_rows=True)
    return infill(first, second, va.PLACE)


def benchmark_auroc(models: dict[str, DataFrame], mpra: DataFrame, p: float = 1e-5,
                    abs_effect: float = 0.05, named: Sequence[str] = (),
                    alt_col: str = "allele") -> DataFrame:
    """Area per model on all variants, named regions, region types and regions."""
    pos, neg = va.class_labels(p)
    rows = va.add_class_labels(matched_models(models, mpra, alt_col), p, None, abs_effect, pos, neg)
    return me.auroc_by_subset(rows.dropna(subset=["label"]), "log2FC", "label", pos, "model",
                              ["region_type", "region"], [("region", r) for r in named])


def direction_report(rows: DataFrame, pos: str, score: str = "log2FC", label: str = "label") -> DataFrame:
    """Area, best cutoff and phi coefficient for effects up, down and both.

    Scores are signed for effects up, negated for effects down, absolute for both.
    """
    s = F.col(score)
    parts = F.array(F.struct(F.lit("both").alias("d"), F.abs(s).alias("s")),
                    F.struct(F.col("direction").alias("d"),
                             F.when(F.col("direction") == "up", s).otherwise(-s).alias("s")))
    scored = (rows.filter(F.col(label).isNotNull()).select(label, F.explode(parts).alias("_p"))
              .select(label, F.col("_p.d").alias("subset"), F.col("_p.s").alias("score"))
              .filter(F.col("subset").isNotNull()))
    area = me.auroc(scored, "score", label, pos, ["subset"])
    cuts = me.youden_cutoff(scored, "score", label, pos, ["subset"])
    phi = me.mcc_at(scored, "score", label, pos, cuts, ["subset"]).select("subset", "mcc")
    return area.join(cuts, "subset").join(phi, "subset")
