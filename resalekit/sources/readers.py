"""Readers for real raw inputs (CSV exports or Parquet) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from resalekit.sources import schemas


def read_raw(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
             **options) -> DataFrame:
    """Read one raw table. CSV gets the explicit schema (no inference pass), is
    checked against the file's header, and fails on a line that does not fit; ``options`` override. Parquet keeps the file schema and is projected to the expected columns so
    column pruning still reaches the scan."""
    if fmt == "csv":
        reader = spark.read.schema(schema).options(header="true", enforceSchema="false", mode="FAILFAST")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.csv(path)
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def footer_rows(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """A frame of Parquet files to be counted: COUNT(*) over it is pushed down to the files' footers
    and no column is read. ``columns`` (DDL) are those of a folder that may have no files. The reader that pushes aggregates is chosen for this frame alone."""
    listed, pushed = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"
    before = spark.conf.get(listed)
    try:
        spark.conf.set(listed, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
        reader = spark.read.schema(columns) if columns else spark.read
        df = reader.parquet(path)
    finally:
        spark.conf.set(listed, before)
    spark.conf.set(pushed, "true")  # looked up when the count runs; other readers do not push aggregates
    # a count that is pushed to no file at all would be null
    return df if len(df._jdf.inputFiles()) else spark.createDataFrame([], df.schema)


def read_raw_events(spark, path, fmt="parquet", **options):
    return read_raw(spark, path, schemas.RAW_EVENTS, fmt, **options)


def read_raw_entities(spark, path, fmt="parquet", **options):
    return read_raw(spark, path, schemas.RAW_ENTITIES, fmt, **options)


def read_geo_map(spark, path, fmt="parquet", **options):
    return read_raw(spark, path, schemas.GEO_MAP, fmt, **options)
