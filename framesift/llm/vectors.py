"""Vector columns: which rows take part, and their components as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(column: str = "embedding") -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    x = F.col(column)
    inside = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(inside, F.lit(False))


def usual_length(rows: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have (of equals the shorter); 0 without vectors."""
    found = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0]["n"] if found else 0


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
