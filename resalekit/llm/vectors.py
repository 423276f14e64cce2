"""Integer vectors out of float ones, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components below this have products and squared differences that stay exact in float64 and int64, for 64 of them and more.
SMALL = 1 << 22
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: str, size: int | None = None) -> Column:
    """Whether the vector (of ``size``, if given) has no null and no component that is not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))
    return whole & (F.size(vector) == size) if size is not None else whole


def scaled(values: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of doubles: int64, or Python's ints where one is not small. ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale)
    if not whole.size or np.abs(whole).max() < SMALL:
        return whole.astype(np.int64)
    exact = [int(x) if abs(x) < 1e300 else int(v) * int(scale) for x, v in zip(whole.ravel().tolist(), values.ravel().tolist())]
    return np.array(exact, object).reshape(whole.shape)


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def longs(values) -> pa.Array:
    """Integers as longs; null where one has no such value."""
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if LONG[0] <= v <= LONG[1] else None for v in values], pa.int64())
