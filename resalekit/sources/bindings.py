"""Bind generic star-schema tables to the raw event/entity/geo shapes.

The driver data has no property tables, so the raw inputs are derived from
``orders`` (events), ``customer`` (entities) and ``nation`` x ``region``
(geography map). Every derived column is a projection of the source row, so
the bound tables grow with the source tables and keep their partitioning;
nothing is collected or generated on the driver. ``bind_lineitem`` is the
larger binding used by the benchmark (``lineitem`` events, ``part`` entities).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resalekit.sources.readers import footer_rows, read_geo_map, read_raw_entities, read_raw_events


@dataclass(frozen=True)
class RawTables:
    events: DataFrame      # price_history shape
    entities: DataFrame    # properties_main shape
    geo: DataFrame         # postcode_region_map shape
    #: By field, what reads a frame of as many rows that is cheaper to count, where the source has one.
    countable: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def to_count(self, name: str) -> DataFrame:
        return self.countable[name]() if name in self.countable else getattr(self, name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_at(sf_dir, name))


def _countable(spark: SparkSession, events: str, entities: str) -> dict[str, Callable[[], DataFrame]]:
    """Events and entities have a row per row of these Parquet files."""
    return {"events": partial(footer_rows, spark, events), "entities": partial(footer_rows, spark, entities)}


def _at(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _money_text(c: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(c, 2))


def _letter(n: Column) -> Column:
    return F.chr(F.lit(65) + n)


def geo_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Eight districts per nation, half of them padded and lower-cased so the
    enrichment join has to normalise its key; district 9 stays unmapped."""
    d = F.col("d")
    letter = _letter(F.col("n_nationkey"))
    district = F.when(d % 2 == 0, F.concat(F.lit(" "), F.lower(letter), d.cast("string"), F.lit(" "))) \
                .otherwise(F.concat(letter, d.cast("string")))
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("d"))
            .select(district.alias("postcode_district"),
                    letter.alias("postcode_area"),
                    F.col("n_name").alias("postcode_area_name"),
                    F.col("r_name").alias("region"),
                    F.concat(F.lit("C"), (F.col("r_regionkey") % 2).cast("string")).alias("country")))


# Defects that the checks look for are part of the bound shapes: rows whose
# key is divisible by these numbers have one.
NO_DATE, NO_PRICE, NO_ENTITY, NO_EVENTS, NO_POSTCODE = 97, 89, 211, 53, 71


def _address(key: Column, nation_idx: Column) -> Column:
    code = F.concat(
        F.lit(", "), F.lower(_letter(nation_idx)), (key % 9 + 1).cast("string"),
        F.when(key % 50 == 0, F.lit("")).otherwise(F.lit(" ")),
        (key % 7 + 1).cast("string"), F.lit("aa"))
    return F.concat(key.cast("string"), F.lit(" Test Road"), F.when(key % NO_POSTCODE == 0, F.lit("")).otherwise(code))


def _unless(defect: Column, value: Column, instead=None) -> Column:
    return F.when(defect, F.lit(instead)).otherwise(value)


def _event_columns(row: Column, key: Column, date: str, price: str, flag: Column) -> list[Column]:
    """Events of entity ``key``; ``row`` numbers them for the defects."""
    return [
        F.when(row % NO_ENTITY == 0, -key).otherwise(key).alias("property_id"),
        _unless(row % NO_DATE == 0, F.date_format(date, "yyyy-MM-dd")).alias("deedDate"),
        _unless(row % NO_PRICE == 0, _money_text(F.col(price)), "POA").alias("displayPrice"),
        flag.alias("newBuild"),
    ]


def _entity_columns(key: Column, nation_idx: Column, ptype: Column, balance: Column) -> list[Column]:
    return [
        F.when(key % NO_EVENTS == 0, -key).otherwise(key).alias("property_id"),
        _address(key, nation_idx).alias("address"),
        F.when(key % 40 == 0, F.lit(None).cast("string")).otherwise(ptype).alias("property_type"),
        F.when(key % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sub"), (key % 4).cast("string"))).alias("property_subtype"),
        (key % 6).cast("int").alias("bedrooms"),
        (key % 3).cast("int").alias("bathrooms"),
        F.when(key % 5 == 0, "Leasehold").when(key % 5 == 1, "Freehold")
         .when(key % 5 == 2, "Freehold").when(key % 5 == 3, "Feudal").alias("tenure"),
        _money_text(balance).alias("latest_price"),
        F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), (key % 900).cast("int")),
                      "yyyy-MM-dd").alias("latest_date"),
        (key % 10 == 0).alias("new_build"),
    ]


def bind_orders(spark: SparkSession, sf_dir: str) -> RawTables:
    """orders -> events, customer -> entities, nation x region -> geo map."""
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    status = F.col("o_orderstatus")
    events = orders.select(*_event_columns(
        F.col("o_orderkey"), F.col("o_custkey"), "o_orderdate", "o_totalprice",
        F.when(status == "O", True).when(status == "F", False)))
    entities = customer.select(*_entity_columns(
        F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_acctbal")))
    geo = geo_from_nations(_read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region"))
    return RawTables(events, entities, geo, _countable(spark, _at(sf_dir, "orders"), _at(sf_dir, "customer")))


def bind_lineitem(spark: SparkSession, sf_dir: str) -> RawTables:
    """lineitem -> events (part key, ship date, extended price, return flag),
    part -> entities (type as entity type); 4x the rows of ``bind_orders``."""
    li = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")
    flag = F.col("l_returnflag")
    events = li.select(*_event_columns(
        F.col("l_orderkey"), F.col("l_partkey"), "l_shipdate", "l_extendedprice",
        F.when(flag == "R", True).when(flag == "N", False)))
    key = F.col("p_partkey")
    entities = part.select(*_entity_columns(key, key % 25, F.col("p_type"), F.col("p_retailprice")))
    geo = geo_from_nations(_read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region"))
    return RawTables(events, entities, geo, _countable(spark, _at(sf_dir, "lineitem"), _at(sf_dir, "part")))


def bind_raw(spark: SparkSession, events: str, entities: str, geo: str, fmt: str = "parquet", **options) -> RawTables:
    """Raw tables at three paths, in the documented shapes (see ``sources.readers``)."""
    countable = _countable(spark, events, entities) if fmt == "parquet" and not options else {}
    return RawTables(read_raw_events(spark, events, fmt, **options), read_raw_entities(spark, entities, fmt, **options),
                     read_geo_map(spark, geo, fmt, **options), countable)


BINDINGS = {"orders": bind_orders, "lineitem": bind_lineitem}
