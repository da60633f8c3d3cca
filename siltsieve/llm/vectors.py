"""Helpers for tables of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(name: str, scale: int, limit: float) -> Column:
    """floor(scale * entry) of every entry, as doubles that hold whole numbers; null where the vector or an entry is null, not finite, or gives limit or more in absolute value."""
    scaled = F.transform(F.col(name), lambda c: F.lit(float(scale)) * c.cast("double"))
    good = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < limit))
    return F.when(good, F.transform(scaled, lambda y: F.floor(y).cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of equal width without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """The inverse of matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))
