"""Integer vectors: the kept rows of a vector column, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of 2^31 and more are refused: products of such vectors would leave 64 bits.
WIDEST = 1 << 31


def whole(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; false for a null one."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def component_ranges(rows: DataFrame, q: str) -> list:
    """(pos, n, lo, hi, mean, spread) of each component: as many rows as the longest vector has.

    Raises ValueError if a component is ``WIDEST`` or more.
    """
    v = F.col("col").cast("double")
    found = rows.select(F.posexplode(q)).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.min("col").alias("lo"), F.max("col").alias("hi"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("spread")).orderBy("pos").collect()
    if any(max(-r["lo"], r["hi"]) >= WIDEST for r in found):
        raise ValueError(f"vector components must be below {WIDEST} in size")
    return found


def matrix(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    n, column = len(column), column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == n * dims and (n == 0 or (np.diff(column.offsets.to_numpy()) == dims).all()):
        return flat.reshape(n, dims).astype(kind, copy=False)
    out, ends = np.zeros((n, dims), kind), column.offsets.to_numpy() - column.offsets[0].as_py()
    for i in range(n):
        out[i, :ends[i + 1] - ends[i]] = flat[ends[i]:ends[i + 1]]
    return out


def exact_kind(bound: int):
    """The fastest number type in which every partial sum of size ``bound`` is exact."""
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise ValueError("products of these vectors do not fit into 64 bits")
