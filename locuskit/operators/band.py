"""Joins with a range condition, on cuts that follow the data.

Where intervals have no common scale (scores, times, positions of very uneven density) fixed bins
do not help. Here the ordered side is cut into pieces of equal row numbers instead: its distinct
values are numbered by running totals, an interval asks for the pieces between the numbers of
its two ends, and both sides meet by hash on the piece. Pieces whose rows on a side exceed
the limit, a single hot value for instance, or a place under very many intervals, are dealt
into several by a hash of the row, and the other side is repeated for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.operators.ordered import running_totals
from locuskit.operators.joins import skew_join


def _numbered(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, upto, n): rows of the ordered side up to and at each value."""
    totals = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return running_totals(totals, keys, "value", ["n"]).select(*keys, "value", F.col("cum_n").alias("upto"), "n")


def _dealt(rows: DataFrame, sizes: DataFrame, on: Sequence[str], own: str, other: str, own_name: str,
           other_name: str) -> DataFrame:
    """Own rows fall into one part of their piece by content and meet every part of the other side."""
    parts = lambda c: F.coalesce(F.col(c), F.lit(1))
    names = rows.columns
    marked = skew_join(rows, sizes, on).select(*[F.col(f"l.`{c}`") for c in names], f"r.{own}", f"r.{other}")
    content = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    return marked.select(*[F.col(f"`{c}`") for c in names], F.pmod(content, parts(own)).cast("int").alias(own_name),
                         F.explode(F.sequence(F.lit(0), parts(other).cast("int") - 1)).alias(other_name))


def range_join(left: DataFrame, right: DataFrame, lo: Column, hi: Column, at: Column, keys: Sequence[str],
               condition: Column | None = None, piece_rows: int = 10_000) -> DataFrame:
    """Pairs with equal ``keys`` and lo <= at <= hi; sides are aliased ``l`` and ``r``.

    ``lo`` and ``hi`` are numeric expressions over ``left``, ``at`` over ``right``; ``condition``
    uses the aliases. The parts of a piece hold about ``piece_rows`` rows of a side at most, so
    a task compares about ``piece_rows`` ** 2 pairs. An interval that covers many pieces has a
    row for each of them, and a piece it covers whole gives a pair for every row. NULL keys,
    bounds and positions match nothing.
    """
    null = lambda names: [F.col(n).isNotNull() for n in names]
    a = left.select("*", lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi")).filter(F.col("_lo") <= F.col("_hi"))
    b = right.select("*", at.cast("double").alias("_at"))
    for test in null(keys):
        a, b = a.filter(test), b.filter(test)
    b = b.filter(F.col("_at").isNotNull())
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    values = b.groupBy(*keys, F.col("_at").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    for end in ("_lo", "_hi"):
        values = values.unionByName(a.select(*keys, F.col(end).alias("value"), none.alias("n")).distinct())
    numbers = _numbered(values, keys)
    piece = lambda upto: F.floor(upto / piece_rows)

    def look(rows: DataFrame, column: str, name: str, number: Column) -> DataFrame:
        side = numbers.select(*keys, F.col("value").alias(column), number.alias(name))
        joined = skew_join(rows, side, [*keys, column])
        return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], f"r.{name}")

    # a value's rows are all in the piece in which its first one is
    placed = look(b, "_at", "_piece", piece(F.col("upto") - F.col("n")))
    spans = look(look(a, "_lo", "_p", piece(F.col("upto") - F.col("n"))), "_hi", "_q", piece(F.greatest(F.col("upto") - one, none)))
    spans = spans.select(*[F.col(f"`{c}`") for c in a.columns], F.explode(F.sequence("_p", F.greatest("_p", "_q"))).alias("_piece"))
    on = [*keys, "_piece"]
    count = lambda rows, name: rows.groupBy(*on).agg(
        F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias(name))
    sizes = count(spans, "_cl").join(count(placed, "_cr"), on)
    x = _dealt(spans, sizes, on, "_cl", "_cr", "_sl", "_sr")
    y = _dealt(placed, sizes, on, "_cr", "_cl", "_sr", "_sl")
    inside = (F.col("r._at") >= F.col("l._lo")) & (F.col("r._at") <= F.col("l._hi"))
    return skew_join(x, y, [*on, "_sl", "_sr"], inside if condition is None else inside & condition)
