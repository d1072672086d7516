"""Running totals, exact ranks and exact quantiles without one-task windows.

A window ordered over a whole table, or over a key that owns a third of it, is one
task. Here the ordering column is cut into *segments* at approximate quantiles of its
distinct values. Each (key, segment) piece is ordered in a task of its own, and the
small table of piece totals (at most keys x segments rows) supplies the offsets.
Callers hand in ``counts``: rows already collapsed to distinct (keys, order value), so
a value shared by a third of all rows is a single row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.session import shuffle_partitions

TIERED_ABOVE = 32


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Rows per distinct (keys, value) as ``n``, plus sums of further columns."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliased frames."""
    return reduce(lambda a, b: a & b,
                  [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def with_group_values(rows: DataFrame, table: DataFrame, keys: Sequence[str],
                      columns: Sequence[str]) -> DataFrame:
    """Rows with ``columns`` of their group's row in ``table``; NULL keys meet NULL keys.

    Without keys the table is a single row, read as a scalar. Rows without a group go.
    """
    if not keys:
        one = table.select(F.struct(*columns).alias("s")).scalar()
        return rows.filter(one.isNotNull()).select("*", *[one[c].alias(c) for c in columns])
    joined = rows.alias("l").join(table.alias("r"), same_keys("l", "r", keys))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in columns])


def with_segment(counts: DataFrame, order: str, weights: Sequence[str]) -> DataFrame:
    """Add ``_seg``: how many segment bounds lie below the order value."""
    pieces = max(2, shuffle_partitions(counts))
    # the weights are summed too so that this branch reads the very columns of the main
    # one, which lets adaptive execution reuse the shuffle underneath
    bounds = counts.agg(F.struct(
        F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 20 * pieces).alias("at"),
        *[F.sum(w).alias(f"_{i}") for i, w in enumerate(weights)]).alias("b")).scalar()
    at, value = F.col("_at"), F.col(order)

    def below(first: Column, step: int, count: int) -> Column:
        """How many of ``count`` bounds, from ``first`` on in steps, are below the value."""
        tests = [F.coalesce((F.get(at, first + i * step) < value).cast("int"), F.lit(0))
                 for i in range(count)]
        return reduce(lambda a, b: a + b, tests)

    out = counts.withColumn("_at", bounds["at"])
    if pieces <= TIERED_ABOVE:
        return out.withColumn("_seg", below(F.lit(0), 1, pieces - 1)).drop("_at")
    step = int(pieces ** 0.5)
    tiers = (pieces - 1) // step
    out = out.withColumn("_tier", below(F.lit(step - 1), step, tiers) * step)
    return (out.withColumn("_seg", F.col("_tier") + below(F.col("_tier"), 1, step))
            .drop("_at", "_tier"))


def _piece_totals(tagged: DataFrame, keys: Sequence[str], sums: Sequence[str],
                  descending: bool) -> DataFrame:
    order = F.col("_seg").desc() if descending else F.col("_seg")
    whole = W.partitionBy(*keys)
    before = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_seg").agg(*[F.sum(c).alias(c) for c in sums])
    return totals.select(
        *keys, "_seg",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"_all_{c}") for c in sums],
        *[F.col(c).alias(f"_piece_{c}") for c in sums])


def running_totals(counts: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                   descending: bool = False, keep_segment: bool = False) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum) and ``all_<c>`` (sum over the key)."""
    tagged = with_segment(counts, order, sums)
    offsets = _piece_totals(tagged, keys, sums, descending)
    ordering = F.col(order).desc() if descending else F.col(order)
    window = (W.partitionBy(*keys, "_seg").orderBy(ordering)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    local = tagged.select("*", *[F.sum(c).over(window).alias(f"_local_{c}") for c in sums])
    joined = local.alias("v").join(offsets.alias("o"), same_keys("v", "o", [*keys, "_seg"]))
    return joined.select(
        *[F.col(f"v.{c}") for c in counts.columns],
        *[(F.col(f"v._local_{c}") + F.col(f"o._before_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"o._all_{c}").alias(f"all_{c}") for c in sums],
        *([F.col("v._seg")] if keep_segment else []))


def values_at_ranks(counts: DataFrame, keys: Sequence[str], value: str,
                    ranks: dict[str, Column], weight: str = "n", tie: str | None = None) -> DataFrame:
    """(keys, label, rank, total, value, below): the value at 1-based rank ``ranks[label]``.

    Rank expressions may use ``F.col("total")``, the number of rows of the key. Only
    pieces that hold a wanted rank are ordered, so little is shuffled beyond ``counts``.
    With ``tie`` the rows of ``counts`` need not be distinct in ``value``; that column
    orders equal ones and is returned as well.
    """
    more = [tie] if tie else []
    tagged = with_segment(counts, value, [weight])
    pieces = _piece_totals(tagged, keys, [weight], False).withColumnRenamed(f"_all_{weight}", "total")
    wanted = F.array(*[F.struct(F.lit(label).alias("label"), rank.cast("bigint").alias("rank"))
                       for label, rank in ranks.items()])
    start, size = F.col(f"_before_{weight}"), F.col(f"_piece_{weight}")
    targets = (pieces.withColumn("_wanted", wanted)
               .withColumn("_wanted", F.filter("_wanted", lambda r: (r["rank"] > start)
                                               & (r["rank"] <= start + size)))
               .filter(F.size("_wanted") > 0)
               .select(*keys, "_seg", "total", "_wanted", start.alias("_start")))
    held = (tagged.alias("v").join(targets.alias("t"), same_keys("v", "t", [*keys, "_seg"]))
            .select(*[F.col(f"v.{k}") for k in [*keys, "_seg", value, weight, *more]],
                    "t.total", "t._wanted", "t._start"))
    window = (W.partitionBy(*keys, "_seg").orderBy(value, *more)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    cum = held.withColumn("_cum", F.col("_start") + F.sum(weight).over(window))
    upto, here = F.col("_cum"), F.col(weight)
    return (cum.withColumn("_hit", F.filter("_wanted", lambda r: (r["rank"] > upto - here)
                                            & (r["rank"] <= upto)))
            .filter(F.size("_hit") > 0)
            .select(*keys, F.explode("_hit").alias("_hit"), "total",
                    F.col(value).alias("value"), (upto - here).alias("below"), *more)
            .select(*keys, F.col("_hit.label").alias("label"), F.col("_hit.rank").alias("rank"),
                    "total", "value", "below", *more))


def exact_quantiles(counts: DataFrame, keys: Sequence[str], value: str,
                    quantiles: dict[str, tuple[float, str]], weight: str = "n") -> DataFrame:
    """One row per key: ``total`` and every named quantile.

    ``quantiles`` maps an output name to (probability, kind); kind ``disc`` takes a
    member of the group, kind ``cont`` interpolates between neighbours.
    """
    total = F.col("total")
    ranks: dict[str, Column] = {}
    for name, (prob, kind) in quantiles.items():
        if kind == "disc":
            ranks[name] = F.greatest(F.ceil(F.lit(float(prob)) * total), F.lit(1))
        else:
            spot = F.lit(float(prob)) * (total - 1)
            ranks[f"{name}|lo"] = F.floor(spot) + 1
            ranks[f"{name}|hi"] = F.ceil(spot) + 1
    found = values_at_ranks(counts, keys, value, ranks, weight)
    picked = found.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("label") == label, F.col("value"))).alias(label) for label in ranks])
    out = []
    for name, (prob, kind) in quantiles.items():
        if kind == "disc":
            out.append(F.col(name))
        else:
            spot = F.lit(float(prob)) * (total - 1)
            lo, hi = F.col(f"`{name}|lo`"), F.col(f"`{name}|hi`")
            out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, "total", *out)


def take_first(df: DataFrame, k: int | Column, order: Sequence[str],
               rare_ties: bool = False) -> DataFrame:
    """Exactly the first ``k`` rows by the numeric columns ``order`` (last one unique).

    ``k`` may be an expression over ``F.col("total")``. Rows with a NULL in an order column
    are never taken, NaN comes after every number. The cutoff value of each order column is
    found and the rows are filtered in place, so no row is shuffled and no task holds the
    sample, whatever ``k`` is. Each order column takes a pass, in which equal values are collapsed, unless ``rare_ties`` says
    that equal values of the first one are rare (random numbers, say): then both of two
    columns are settled in one.
    """
    wanted = F.lit(k) if isinstance(k, int) else k
    upto = {"k": F.least(wanted, F.col("total"))}
    if rare_ties:
        first, second = order
        rows = df.select(first, second, F.lit(1).alias("n")).filter(F.col(first).isNotNull())
        cut = values_at_ranks(rows, [], first, upto, tie=second).select(
            F.struct("value", F.col(second).alias("tie")).alias("s")).scalar()
        return df.filter((F.col(first) < cut["value"])
                         | ((F.col(first) == cut["value"]) & (F.col(second) <= cut["tie"])))
    df = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in order]))
    keep, tied, ties = F.lit(False), F.lit(True), df
    for column in order:
        cut = values_at_ranks(value_counts(ties, [], column), [], column, upto)
        spot = cut.select(F.struct("value", (F.col("rank") - F.col("below")).alias("left"))
                          .alias("s")).scalar()
        keep = keep | (tied & (F.col(column) < spot["value"]))
        tied = tied & (F.col(column) == spot["value"])
        ties, upto = df.filter(tied), {"k": F.least(spot["left"], F.col("total"))}
    return df.filter(keep | tied)


def take_first_each(df: DataFrame, k: int, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """The first ``k`` rows of each group by the numeric columns ``order`` and ``tie`` (unique in it).

    As :func:`take_first`, with a cutoff for each group: rows are compared with their group's row
    of a small table, and only those that tie with the cutoff are ordered, in pieces. No task
    holds a group, whatever its size and ``k`` are. Rows with a NULL in ``order`` or ``tie`` are
    never taken; NULL keys form a group.
    """
    rows = df.filter(F.col(order).isNotNull() & F.col(tie).isNotNull())
    cuts = values_at_ranks(value_counts(rows, keys, order), keys, order, {"k": F.least(F.lit(k), F.col("total"))})
    cuts = cuts.select(*keys, F.col("value").alias("_cut"), (F.col("rank") - F.col("below")).alias("_left"))
    marked = with_group_values(rows, cuts, keys, ["_cut", "_left"])
    tied = running_totals(marked.filter(F.col(order) == F.col("_cut")).withColumn("_one", F.lit(1)), keys, tie, ["_one"])
    return marked.filter(F.col(order) < F.col("_cut")).select(*df.columns).unionByName(
        tied.filter(F.col("cum__one") <= F.col("_left")).select(*df.columns))
