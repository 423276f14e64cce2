"""Consecutive-event operators: change since the previous event
and time to the next event (W19).

Windows are partitioned by the entity key. After cleaning, (key, date) is
unique, so one entity has at most one row per calendar day: a window
partition is bounded by the number of distinct dates, not by the data size,
and a hot entity cannot pile an unbounded share of rows into one task. The
enriched frame arrives hash-partitioned by the key (shuffle join), so these
windows add no exchange of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalekit.functions.median import group_median
from resalekit.functions.numeric import pct_change, round_half_up, years_between


def consecutive_change(h: DataFrame, by: Sequence[str] = ("property_type",), *,
                       key: str = "property_id", date: str = "sale_date",
                       price: str = "sale_price", floor: float | None = 10000,
                       median_alias: str = "median_percent_price_change",
                       count_alias: str = "resale_events_used", digits: int = 1) -> DataFrame:
    """Median % change from the previous event to this one, per group.

    Events below ``floor`` are removed *before* the LAG, so a cheap event is
    skipped over rather than breaking the chain. Only events with a previous
    event count. Output: ``by``, median (rounded to ``digits``), count;
    ordered by the median, largest first.
    """
    by = list(by)
    events = h.where(F.col(date).isNotNull())
    if floor is not None:
        events = events.where(F.col(price) >= F.lit(floor))
    w = Window.partitionBy(key).orderBy(date)
    changes = (events.select(*by, F.col(price).alias("_p"),
                             F.lag(price).over(w).alias("_prev"))
               .where(F.col("_prev").isNotNull())
               .select(*by, pct_change("_p", "_prev").alias("_pct")))
    med = group_median(changes, by, "_pct", "_m", count_alias=count_alias)
    out = med.select(*by, round_half_up("_m", digits).alias(median_alias), count_alias)
    return out.orderBy(F.col(median_alias).desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in by])


def time_to_next(h: DataFrame,
                 by: Sequence[str] = ("property_type", "postcode_area", "postcode_area_name"), *,
                 key: str = "property_id", date: str = "sale_date",
                 median_alias: str = "median_years_to_next_sale",
                 count_alias: str = "resale_pairs_count", digits: int = 1) -> DataFrame:
    """Median years (days / 365.25) from each event to the entity's next
    event, and the number of such pairs, per group. No price filter."""
    by = list(by)
    w = Window.partitionBy(key).orderBy(date)
    pairs = (h.where(F.col(date).isNotNull())
             .select(*by, F.col(date).alias("_d"), F.lead(date).over(w).alias("_next"))
             .where(F.col("_next").isNotNull())
             .select(*by, years_between("_next", "_d").alias("_years")))
    med = group_median(pairs, by, "_years", "_m", count_alias=count_alias)
    out = med.select(*by, round_half_up("_m", digits).alias(median_alias), count_alias)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in by])
