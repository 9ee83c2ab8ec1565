"""Vectors of a table as matrices, for the operators that compute on them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame) -> DataFrame:
    """The rows whose ``embedding`` is there and holds neither nulls nor non-finite components, as doubles."""
    x = F.col("embedding").cast("array<double>")
    return vectors.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).withColumn("embedding", x)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as ``(rows, components)``; vectors of several lengths fail the job with a message."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("the vectors have several lengths")
    return np.asarray(column.flatten()).reshape(len(column), int(lengths[0]) if len(lengths) else 0)


def floors(x: np.ndarray, scale: float, most: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; a component whose floor is ``most`` or more fails with a message."""
    y = np.floor(x * scale)
    if len(y) and np.abs(y).max(initial=0) >= most:
        raise ValueError(f"a component times {scale:g} reaches {most:g}")
    return y.astype(np.int64)
