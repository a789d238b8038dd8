"""Rows of vectors: which take part, one row an id, and matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector has a component and all of them are finite numbers; null as false."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def one_per_id(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of rows that share an id the smallest by the other columns, in their order. Whole rows are shuffled only if an id repeats."""
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("m")).select(key, *(F.col("m").getField(c).alias(c) for c in rest))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, a row each, in double precision."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks if len(c)]
    return np.concatenate(flat).astype(np.float64).reshape(sum(map(len, chunks)), -1) if flat else np.zeros((0, 0))
