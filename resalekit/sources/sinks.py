"""Result sink (W36): write an analysis result for a dashboard to read."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Rows that ``single_file`` accepts: one task writes them.
SINGLE_FILE_ROWS = 1_000_000


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, single_file: bool = False) -> str:
    """Write ``df`` to ``path`` (a shared filesystem / object-store URI).

    ``single_file`` writes one file, for tools that want one CSV, and refuses a
    frame of more than ``SINGLE_FILE_ROWS`` rows (a bounded count is taken first).
    Leave it off for entity- or event-level frames, which are written in parallel.
    """
    out = df
    if single_file:
        if df.limit(SINGLE_FILE_ROWS + 1).count() > SINGLE_FILE_ROWS:
            raise ValueError(f"more than {SINGLE_FILE_ROWS} rows for a single file")
        out = df.coalesce(1)
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
