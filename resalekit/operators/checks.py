"""Profiling and integrity checks.

Each returns a small DataFrame (one or a few rows); they are global or
grouped aggregates with map-side partial aggregation, so the work is spread
over the cluster and only partial counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalekit.functions.numeric import parse_date
from resalekit.functions.text import extract_postcode


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows) per named table, in the given order."""
    parts = [single_count(df).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def single_count(df: DataFrame, alias: str = "rows") -> DataFrame:
    """COUNT(*) as one named column. A count that is pushed down to files without a row is null in Spark; it is 0 here."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(alias))


def date_range(df: DataFrame, date: str = "deedDate", *, formats=None,
               names: tuple[str, str] = ("earliest_deedDate", "latest_deedDate")) -> DataFrame:
    """MIN and MAX of the date parsed from text."""
    d = parse_date(date, formats)
    return df.agg(F.min(d).alias(names[0]), F.max(d).alias(names[1]))


def events_per_year(df: DataFrame, date: str = "deedDate", value: str = "displayPrice", *,
                    formats=None, names: tuple[str, str] = ("sale_year", "sale_price")) -> DataFrame:
    """Per year of the parsed date: number of non-null ``value`` entries.
    (The reference names the count ``sale_price``; kept for parity.)"""
    year = F.year(parse_date(date, formats)).cast("int")
    return (df.groupBy(year.alias(names[0]))
            .agg(F.count(F.col(value)).alias(names[1]))
            .orderBy(F.col(names[0]).asc_nulls_last()))


def null_profile(df: DataFrame, total_alias: str | None = "total_rows",
                 nonnull: Mapping[str, str] | None = None,
                 nulls: Mapping[str, Column | str] | None = None) -> DataFrame:
    """One row: total rows, non-null counts (alias -> column) and null
    counts (alias -> column or expression), all in a single pass."""
    aggs = []
    if total_alias:
        aggs.append(F.count(F.lit(1)).alias(total_alias))
    for alias, c in (nonnull or {}).items():
        aggs.append(F.count(F.col(c) if isinstance(c, str) else c).alias(alias))
    for alias, c in (nulls or {}).items():
        col = F.col(c) if isinstance(c, str) else c
        aggs.append(F.count_if(col.isNull()).alias(alias))
    return df.agg(*aggs)


def orphans(left: DataFrame, right: DataFrame, key: str = "property_id",
            alias: str = "orphan_rows") -> DataFrame:
    """Number of ``left`` rows whose key has no row in ``right`` (anti join).

    Both sides are reduced to one row per key, with map-side partial
    aggregation, before they meet: a key with a third of all rows is one row. A
    NULL key has no partner."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    missing = counts.join(right.select(key).distinct(), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(alias))


def cardinality(df: DataFrame, key: str = "property_id") -> DataFrame:
    """total_rows, total_properties (distinct keys) and the integer (truncating)
    average rows per key, as ``count(*) / count(distinct key)`` gives on
    bigint operands in SQL engines with integer division."""
    out = df.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_distinct(F.col(key)).alias("total_properties"))
    return out.withColumn("avg_prices_per_property",
                          F.expr("total_rows div nullif(total_properties, 0)"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("property_id", "deedDate"),
                   rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keys with more than one row and their row count, most first."""
    rename = dict(rename or {"deedDate": "sale_date"})
    grouped = (df.groupBy(*[F.col(k).alias(rename.get(k, k)) for k in keys])
               .agg(F.count(F.lit(1)).alias("count"))
               .where(F.col("count") > 1))
    return grouped.orderBy(F.col("count").desc(), *[F.col(rename.get(k, k)) for k in keys])


def grain_violations(df: DataFrame, keys: Sequence[str] = ("property_id", "sale_date"),
                     alias: str = "violations") -> DataFrame:
    """Number of key groups with more than one row (0 when the grain holds)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    return dup.agg(F.count(F.lit(1)).alias(alias))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise when ``keys`` repeat in ``df`` (run before a lookup join that
    would otherwise fan out)."""
    n = grain_violations(df, keys).first()[0]
    if n:
        raise ValueError(f"{what}: {n} key groups of {list(keys)} have more than one row")


def clean_null_checks(clean_entities: DataFrame) -> DataFrame:
    """null_postcode, null_latest_sale_price, missing_latest_sale_date."""
    return null_profile(clean_entities, total_alias=None, nulls={
        "null_postcode": "postcode",
        "null_latest_sale_price": "latest_sale_price",
        "missing_latest_sale_date": "latest_sale_date",
    })


def postcode_coverage(raw_entities: DataFrame, address: str = "address") -> DataFrame:
    """total_rows and how many addresses yield a postcode."""
    return null_profile(raw_entities, "total_rows", nonnull={
        "postcode_found": extract_postcode(address)})
