"""Arithmetic with NULL in place of division by zero and logarithm of zero."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

P_FLOOR = 1e-20


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ln_to_log2(value: Column) -> Column:
    return value / F.lit(math.log(2))


def log2_or_null(value: Column) -> Column:
    return F.log2(F.when(value > 0, value))


def log10_floored(p: Column) -> Column:
    """log10 of a p-value shifted by 1e-20 so that zero stays finite."""
    return F.log10(p + F.lit(P_FLOOR))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns of a row, NULLs skipped, NULL if all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, known)


def row_min(columns: Sequence[Column]) -> Column:
    """Smallest value over the columns of a row, NULLs skipped."""
    return F.least(*columns) if len(columns) > 1 else columns[0]


# Rational approximation of the error function (Abramowitz and Stegun
# 7.1.26, absolute error below 1.5e-7)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    size = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * size)
    poly = reduce(lambda acc, a: acc * t + F.lit(a), reversed(ERF_A[:-1]), F.lit(ERF_A[-1])) * t
    return F.signum(x) * (1.0 - poly * F.exp(-size * size))


def lognormal_cdf(x: Column, sigma: float = 1.0, scale: float = 1.0) -> Column:
    """Distribution function of a lognormal; 0 for x <= 0."""
    z = F.ln(F.when(x > 0, x) / F.lit(float(scale))) / F.lit(float(sigma) * math.sqrt(2.0))
    return F.when(x <= 0, F.lit(0.0)).otherwise(0.5 * (1.0 + erf(z)))


def hash_unit(*key: Column, seed: int | str = 0) -> Column:
    """Repeatable number in (0, 1) from a row key: 52 bits of an md5 digest."""
    text = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(2.0 ** 52)
