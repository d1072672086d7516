"""Multiple testing, library-size normalisation and standard scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import columns_matching, ratio, row_mean
from locuskit.operators.joins import skew_join
from locuskit.operators.ordered import running_totals, value_counts

# Fixed value: last point at which the share of null tests is read
LAST_LAMBDA = 0.94


def power_of_ten(value: float) -> float:
    """Power of ten with the exponent truncated toward zero."""
    return 10.0 ** int(math.log10(value))


def _truncated_power(value: Column) -> Column:
    """As :func:`power_of_ten`; written as text because a computed power is not exact."""
    exponent = F.log10(value)
    whole = F.when(exponent < 0, F.ceil(exponent)).otherwise(F.floor(exponent))
    return F.concat(F.lit("1e"), whole.cast("string")).cast("double")


def bonferroni_table(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: number of tests, exact and truncated cutoff (the latter is never smaller)."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    tests = F.col("tests")
    checked = F.when(tests > 0, tests).otherwise(F.raise_error(F.lit("no rows")).cast("bigint"))
    exact = F.lit(alpha) / tests
    return (df.agg(F.count(F.lit(1)).alias("tests")).select(checked.alias("tests"))
            .select("tests", exact.alias("exact"), _truncated_power(exact).alias("cutoff")))


def bonferroni_cutoff(df: DataFrame, alpha: float = 0.05) -> float:
    """The truncated cutoff as a number (runs one count)."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    tests = df.count()
    if tests == 0:
        raise ValueError("no rows")
    return power_of_ten(alpha / tests)


def qvalues(df: DataFrame, p: str = "pvalue", m: float | None = None, pi0: float | None = None,
            out: str = "qvalue", hot_rows: int | None = None, few_tests: int = 100) -> DataFrame:
    """Add step-up q-values; rows with equal p share one.

    The estimated share of null tests is the interpolated count ratio at the last lambda;
    with fewer than ``few_tests`` rows it is taken as 1. A NULL p is an error.
    """
    ok = F.col(p).between(0, 1)
    tested = df.withColumn(p, F.when(ok, F.col(p)).otherwise(
        F.raise_error(F.lit("p-values should be between 0 and 1, none NULL")).cast("double")))
    counts = value_counts(tested, [], p)
    seen = counts.agg(F.struct(F.sum("n").alias("rows"), F.coalesce(F.sum(
        F.when(F.col(p) > LAST_LAMBDA, F.col("n"))), F.lit(0)).alias("above")).alias("s")).scalar()
    tests = seen["rows"].cast("double") if m is None else F.lit(float(m))
    share = F.lit(float(pi0)) if pi0 is not None else F.when(
        seen["rows"] < few_tests, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), seen["above"] / (tests * (1 - LAST_LAMBDA))))
    ranked = running_totals(counts, [], p, ["n"], keep_segment=True)
    raw = ranked.select(p, "_seg", F.least(share * tests * F.col(p) / F.col("cum_n"),
                                           F.when(F.col("cum_n") == F.col("all_n"), 1.0))
                        .alias("_raw"))
    # smallest raw value at this p or any larger one: within the piece, then in later pieces
    local = raw.withColumn("_here", F.min("_raw").over(
        W.partitionBy("_seg").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)))
    later = (raw.groupBy("_seg").agg(F.min("_raw").alias("_piece"))
             .select("_seg", F.min("_piece").over(
                 W.orderBy(F.desc("_seg")).rowsBetween(W.unboundedPreceding, -1)).alias("_later")))
    table = local.join(later, "_seg").select(p, F.least("_here", "_later").alias(out))
    return (skew_join(tested, table, [p], hot_rows=hot_rows)
            .select(*[F.col(f"l.{c}") for c in df.columns], F.col(f"r.{out}")))


def p_at_q(df: DataFrame, q: float = 0.05, p: str = "pvalue", qvalue: str = "qvalue",
           digits: int = 2) -> DataFrame:
    """One row: smallest p among rows whose rounded q equals ``q``, and its power of ten."""
    least = df.filter(F.round(qvalue, digits) == q).agg(F.min(p).alias("p_min"))
    return least.select("p_min", _truncated_power(F.col("p_min")).alias("cutoff"))


def p_cutoff_for_q(df: DataFrame, q: float = 0.05, p: str = "pvalue",
                   qvalue: str = "qvalue") -> float:
    """The truncated cutoff as a number (runs one aggregate)."""
    least = p_at_q(df, q, p, qvalue).first()["p_min"]
    if least is None:
        raise ValueError(f"no row with q = {q}")
    return power_of_ten(least)


def _replicates(df: DataFrame, prefix: str, suffix: str) -> list[str]:
    return columns_matching(df, f"^{prefix}.*{suffix}")


def normalize_by_library(df: DataFrame, per: float = 1e6, dna: str = "input", rna: str = "output",
                         suffix: str = "_rep",
                         rename: Callable[[str], str] | None = lambda c: c + "_norm") -> DataFrame:
    """Add each replicate column divided by its sum, times ``per``.

    With ``rename=None`` the columns are replaced.
    """
    names = _replicates(df, f"({dna}|{rna})", suffix)
    sums = df.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("s")).scalar()
    return df.withColumns({(rename or (lambda c: c))(c):
                           ratio(F.col(c), sums[c]) * F.lit(float(per)) for c in names})


def library_sizes(df: DataFrame, dna: str = "input", rna: str = "output",
                  suffix: str = "_rep") -> DataFrame:
    """(replicate, size) column sums."""
    names = _replicates(df, f"({dna}|{rna})", suffix)
    sums = df.agg(*[F.sum(c).cast("double").alias(c) for c in names])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("replicate"), F.col(c).alias("size")) for c in names])).alias("s")
    ).select("s.*")


def mean_fold_change(df: DataFrame, pseudocount: float = 0.0, dna: str = "input",
                     rna: str = "output", suffix: str = "_rep", out: str = "fold_change") -> DataFrame:
    """Add (mean of RNA replicates + c) / (mean of DNA replicates + c), NULLs skipped."""
    mean = lambda prefix: row_mean([F.col(c) for c in _replicates(df, prefix, suffix)])
    return df.withColumn(out, ratio(mean(rna) + pseudocount, mean(dna) + pseudocount))


def zscore(df: DataFrame, column: str, out: str = "zscore") -> DataFrame:
    """Add (x - mean) / population standard deviation."""
    s = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")).alias("s")).scalar()
    return df.withColumn(out, ratio(F.col(column) - s["mean"], s["sd"]))
