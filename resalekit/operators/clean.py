"""Cleaning of raw events (W09) and raw entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalekit.functions.numeric import parse_date, parse_money
from resalekit.functions.text import extract_postcode, outward_code


def clean_events(raw: DataFrame, key: str = "property_id", date: str = "deedDate",
                 price: str = "displayPrice", flag: str = "newBuild", *,
                 date_formats=None, on_error: str = "raise") -> DataFrame:
    """One row per (key, date): parse date and money, drop rows without a date
    (NULL or, with ``on_error='null'``, unreadable: they have no place among an
    entity's events), and among duplicates keep the highest price (NULL prices last), then the
    flag ordered descending with NULL first (true > false, NULL wins a tie).

    Output: property_id, sale_date, sale_price (decimal(18,2)), new_build_at_sale.

    Plan: one shuffle by (key, sale_date); ``row_number() = 1`` is planned
    as a WindowGroupLimit on both sides of the exchange, so even a
    (key, date) with a third of all rows is cut to one row per map task
    before it moves.
    """
    parsed = (raw.where(F.col(date).isNotNull())
              .select(F.col(key).alias("property_id"),
                      parse_date(date, date_formats, on_error).alias("sale_date"),
                      parse_money(price, on_error).alias("sale_price"),
                      F.col(flag).alias("new_build_at_sale"))
              .where(F.col("sale_date").isNotNull()))
    pick = Window.partitionBy("property_id", "sale_date").orderBy(
        F.col("sale_price").desc_nulls_last(), F.col("new_build_at_sale").desc_nulls_first())
    return (parsed.withColumn("_rn", F.row_number().over(pick))
            .where(F.col("_rn") == 1).drop("_rn"))


def clean_entities(raw: DataFrame, *, date_formats=None, on_error: str = "raise", compact_postcodes: bool = False) -> DataFrame:
    """Entity table with postcode (first match in upper(address)), outward
    district (stored as ``postcode_area``), parsed latest price and date; the
    raw price text is kept as ``latest_price_raw``. ``compact_postcodes`` finds the district of
    postcodes without a space too. Narrow projection, no shuffle."""
    postcode = extract_postcode("address")
    return raw.select(
        "property_id", "address",
        postcode.alias("postcode"),
        outward_code(postcode, compact_postcodes).alias("postcode_area"),
        "property_type", "property_subtype", "bedrooms", "bathrooms", "tenure",
        F.col("latest_price").alias("latest_price_raw"),
        parse_money("latest_price", on_error).alias("latest_sale_price"),
        parse_date("latest_date", date_formats, on_error).alias("latest_sale_date"),
        "new_build",
    )
