"""Choosing and renaming columns by regular expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names in which ``pattern`` is found, in table order."""
    return [c for c in df.columns if re.search(pattern, c)]


def renamed_by_pattern(df: DataFrame, rules: Sequence[tuple[str, str]]) -> list[Column]:
    """Every column, its name rewritten by the (pattern, replacement) rules in turn."""
    out = []
    for name in df.columns:
        new = name
        for pattern, replacement in rules:
            new = re.sub(pattern, replacement, new)
        out.append(F.col(f"`{name}`").alias(new))
    return out
