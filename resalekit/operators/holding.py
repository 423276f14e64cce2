"""First-to-last holding returns per entity.

FIRST_VALUE / LAST_VALUE / COUNT / ROW_NUMBER windows over the entity key
become one grouped aggregate: ``min_by`` / ``max_by`` on the date, with
map-side partial aggregation, so even an entity holding a third of all rows
is reduced before the shuffle and no sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalekit.functions.numeric import (DAYS_PER_YEAR, days_between, growth_power,
                                         round_half_up, safe_div)
from resalekit.sources.schemas import MONEY

# Labels of the review flag and the hold flag (shown to users).
LABEL_BELOW_FLOOR = "Below £10k first price (excluded from ranking)"
LABEL_SHORT_HOLD_YEAR = "Short hold (<1 year)"
LABEL_EXTREME = "Extreme annualized return (>=25%)"
LABEL_SHORT_HOLD_DAYS = "Short hold (<90 days)"
LABEL_NORMAL_HOLD = "Normal hold (90+ days)"


# Attributes of the latest event that the two metric tables carry.
METRIC_ATTRS = ("property_type", "tenure", "region", "postcode_area", "postcode_area_name")
GUARDED_ATTRS = ("property_type", "tenure", "postcode_area_name", "region")


def first_last(h: DataFrame, attrs: list[str], *, key: str = "property_id",
               date: str = "sale_date", price: str = "sale_price",
               drop_null_price: bool = True) -> DataFrame:
    """Per entity: first/last date and the price at each (a NULL price at the
    first or last date is kept as NULL), number of events, and ``attrs``
    taken from the latest event. Only entities with >= 2 events and
    first date < last date are kept. ``drop_null_price`` drops events without a
    key or a price first; without it a NULL key is an entity like any other."""
    base = h.where(F.col(date).isNotNull())
    if drop_null_price:
        base = base.where(F.col(key).isNotNull() & F.col(price).isNotNull())
    latest = F.max_by(F.struct(*[F.col(a) for a in attrs]), F.col(date)) if attrs else None
    aggs = [F.min(date).alias("_first_date"), F.max(date).alias("_last_date"),
            F.min_by(F.col(price), F.col(date)).alias("_first_price"),
            F.max_by(F.col(price), F.col(date)).alias("_last_price"),
            F.count(F.lit(1)).alias("_count")]
    if latest is not None:
        aggs.append(latest.alias("_attrs"))
    g = base.groupBy(F.col(key).alias(key)).agg(*aggs)
    g = g.where((F.col("_count") >= 2) & (F.col("_first_date") < F.col("_last_date")))
    return g.select(key, *[F.col("_attrs").getField(a).alias(a) for a in attrs],
                    "_first_date", "_last_date", "_first_price", "_last_price", "_count")


def _ratio(last: Column, first: Column) -> Column:
    return safe_div(last, first)


def holding_metrics(h: DataFrame, *, key: str = "property_id", date: str = "sale_date",
                    price: str = "sale_price", attrs=METRIC_ATTRS) -> DataFrame:
    """Per entity with 2+ priced events: first/last date and price,
    event count, years held (2 dp), % change (2 dp), absolute gain and the
    annualised return POWER(last/first, 1/years) - 1 in % (2 dp; computed in
    double, an overflow stays +inf)."""
    fl = first_last(h, list(attrs), key=key, date=date, price=price, drop_null_price=True)
    days = days_between("_last_date", "_first_date")
    years_exact = days.cast("double") / F.lit(DAYS_PER_YEAR)
    ratio = _ratio(F.col("_last_price"), F.col("_first_price"))
    cagr = (growth_power(ratio, F.lit(1.0) / F.nullif(years_exact, F.lit(0.0))) - F.lit(1.0)) * F.lit(100.0)
    return fl.select(
        key, *attrs,
        F.col("_first_date").alias("first_date"), F.col("_first_price").alias("first_price"),
        F.col("_last_date").alias("last_date"), F.col("_last_price").alias("last_price"),
        F.col("_count").alias("sales_count"),
        round_half_up(years_exact, 2).alias("years_tracked"),
        round_half_up((ratio - F.lit(1.0)) * F.lit(100.0), 2).alias("pct_change"),
        (F.col("_last_price") - F.col("_first_price")).cast(MONEY).alias("absolute_gain"),
        round_half_up(cagr, 2).alias("annualized_return_raw"))


def review_flag(m: DataFrame, *, floor: float = 10000, short_years: float = 1.0,
                cap: float = 25.0, labels: tuple[str, str, str] | None = None) -> DataFrame:
    """First matching label: first price below ``floor``; held less than
    ``short_years`` (on the rounded years); annualised return >= ``cap``;
    else NULL."""
    below, short, extreme = labels or (LABEL_BELOW_FLOOR, LABEL_SHORT_HOLD_YEAR, LABEL_EXTREME)
    flag = (F.when(F.col("first_price") < F.lit(floor), F.lit(below))
            .when(F.col("years_tracked") < F.lit(short_years), F.lit(short))
            .when(F.col("annualized_return_raw") >= F.lit(cap), F.lit(extreme)))
    return m.select("*", flag.alias("review_flag"))


def guarded_metrics(h: DataFrame, *, key: str = "property_id", date: str = "sale_date",
                    price: str = "sale_price", min_days: int = 90, attrs=GUARDED_ATTRS) -> DataFrame:
    """Like W28 but events with a NULL price stay (so a NULL first or
    last price is possible and counts include them); years to 3 dp; days
    held; annualised return POWER(last/first, 365.25/days) only for holds
    of at least ``min_days`` (else NULL), with a hold label."""
    fl = first_last(h, list(attrs), key=key, date=date, price=price, drop_null_price=False)
    days = days_between("_last_date", "_first_date")
    ratio = _ratio(F.col("_last_price"), F.col("_first_price"))
    cagr = F.when(days >= F.lit(min_days),
                  (growth_power(ratio, F.lit(DAYS_PER_YEAR) / days.cast("double")) - F.lit(1.0)) * F.lit(100.0))
    hold = F.when(days < F.lit(min_days), F.lit(LABEL_SHORT_HOLD_DAYS)).otherwise(F.lit(LABEL_NORMAL_HOLD))
    return fl.select(
        key, *attrs,
        F.col("_first_price").alias("first_recorded_price"),
        F.col("_first_date").alias("first_recorded_date"),
        F.col("_last_price").alias("last_recorded_price"),
        F.col("_last_date").alias("last_recorded_date"),
        F.col("_count").alias("count_recorded_sales"),
        round_half_up((ratio - F.lit(1.0)) * F.lit(100.0), 2).alias("pct_gain"),
        round_half_up(days.cast("double") / F.lit(DAYS_PER_YEAR), 3).alias("years_tracked"),
        days.alias("days_held"),
        round_half_up(cagr, 2).alias("annualized_return"),
        hold.alias("hold_flag"))


def retention(m: DataFrame, *, floor: float = 10000, min_days: int = 90,
              cap: float = 25.0) -> DataFrame:
    """Filter funnel over W31 metrics in one aggregate: eligible (first
    and last price >= floor) -> held >= min_days -> annualised <= cap; the
    three counts and three retention percentages (2 dp)."""
    eligible = (F.col("first_recorded_price") >= F.lit(floor)) & \
               (F.col("last_recorded_price") >= F.lit(floor))
    held = eligible & (F.col("days_held") >= F.lit(min_days))
    capped = held & (F.col("annualized_return") <= F.lit(cap))
    counts = m.agg(F.count_if(eligible).alias("total_eligible"),
                   F.count_if(held).alias("after_90_day_rule"),
                   F.count_if(capped).alias("after_90_day_and_25_cap"))

    def pct(a: str, b: str) -> Column:
        return round_half_up(F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)

    return counts.select(
        "*",
        pct("after_90_day_rule", "total_eligible").alias("pct_remaining_after_90_day_rule"),
        pct("after_90_day_and_25_cap", "after_90_day_rule").alias("pct_remaining_after_25_cap_of_90plus"),
        pct("after_90_day_and_25_cap", "total_eligible").alias("pct_remaining_after_both_filters"))
