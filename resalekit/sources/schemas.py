"""Explicit schemas of the raw inputs and of the tables the library derives.

The raw tables arrive as text (money, dates) exactly as scraped; cleaning
turns them into the typed clean tables below.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Raw event records: one row per recorded price, not unique per (entity, date).
RAW_EVENTS = T.StructType([
    T.StructField("property_id", T.LongType(), False),
    T.StructField("deedDate", T.StringType(), True),
    T.StructField("displayPrice", T.StringType(), True),
    T.StructField("newBuild", T.BooleanType(), True),
])

# Raw entity records: one row per entity.
RAW_ENTITIES = T.StructType([
    T.StructField("property_id", T.LongType(), False),
    T.StructField("address", T.StringType(), True),
    T.StructField("property_type", T.StringType(), True),
    T.StructField("property_subtype", T.StringType(), True),
    T.StructField("bedrooms", T.IntegerType(), True),
    T.StructField("bathrooms", T.IntegerType(), True),
    T.StructField("tenure", T.StringType(), True),
    T.StructField("latest_price", T.StringType(), True),
    T.StructField("latest_date", T.StringType(), True),
    T.StructField("new_build", T.BooleanType(), True),
])

# Geography map keyed by postcode district (join key after upper(trim())).
GEO_MAP = T.StructType([
    T.StructField("postcode_district", T.StringType(), False),
    T.StructField("postcode_area", T.StringType(), True),
    T.StructField("postcode_area_name", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])
