"""Enrichment (W16): clean events + entity attributes + geography labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalekit.functions.numeric import round_half_up
from resalekit.functions.text import label_or_unknown, normalise_key
from resalekit.operators.checks import assert_unique

def enrich(events: DataFrame, entities: DataFrame, geo: DataFrame, *,
           check_keys: bool = False) -> DataFrame:
    """events LEFT JOIN entities ON property_id LEFT JOIN geo ON
    upper(trim(district)); NULL type / subtype / tenure -> 'Unknown'.

    The geography map is joined to the entities first (entity grain, the
    smaller side); the event x entity join is on property_id. Neither join has a
    hint: Spark broadcasts a side only when its size, estimated or
    measured at run time, is below ``spark.sql.autoBroadcastJoinThreshold``, and splits
    skewed partitions otherwise. Same rows as joining the map after the events,
    because the map condition only reads entity columns.

    ``check_keys`` verifies first that neither lookup side repeats its key
    (a repeat would fan out every later per-entity window).
    """
    geo_k = geo.select(normalise_key("postcode_district").alias("_dkey"),
                       "postcode_area", "postcode_area_name", "region", "country")
    if check_keys:
        assert_unique(entities, ["property_id"], "entities")
        assert_unique(geo_k, ["_dkey"], "geography map")
    ent = entities.select(
        "property_id", "address", "postcode",
        F.col("postcode_area").alias("postcode_district"),
        "property_type", "property_subtype", "bedrooms", "bathrooms", "tenure",
        F.col("new_build").alias("property_new_build_flag"),
        normalise_key("postcode_area").alias("_dkey"),
    )
    ent_geo = ent.join(geo_k, "_dkey", "left").drop("_dkey")
    # Labels are defaulted after the join, so events without an entity row
    # also read 'Unknown'.
    return events.join(ent_geo, "property_id", "left").select(
        "property_id", "sale_date", "sale_price", "new_build_at_sale", "address", "postcode",
        "postcode_district",
        label_or_unknown("property_type").alias("property_type"),
        label_or_unknown("property_subtype").alias("property_subtype"),
        "bedrooms", "bathrooms",
        label_or_unknown("tenure").alias("tenure"),
        "property_new_build_flag", "postcode_area", "postcode_area_name", "region", "country")


def match_report(enriched: DataFrame) -> DataFrame:
    """Per district, the events, those that the geography map has no area for, and their share in %
    (2 dp). A NULL district: events without an entity or a postcode."""
    unmatched = F.count_if(F.col("postcode_area").isNull())
    out = enriched.groupBy("postcode_district").agg(F.count(F.lit(1)).alias("sales_count"), unmatched.alias("unmatched_count"))
    share = F.lit(100) * F.col("unmatched_count") / F.col("sales_count")
    return out.select("*", round_half_up(share, 2).alias("pct_unmatched")).orderBy(
        F.col("unmatched_count").desc(), F.col("postcode_district").asc_nulls_last())
