"""Join helper: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension side is broadcast only when it has at most this many rows
# (checked with a bounded count: at most limit + 1 rows are read).
DEFAULT_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when the table has at most ``max_rows`` rows,
    otherwise ``df`` unchanged (the join then shuffles both sides and AQE
    may still demote it to a broadcast at run time)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
