"""Segment medians: period growth (W24/W25), flag premium (W26), medians by
a raw segment with printed labels (W27), shock windows (W34/W35)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resalekit.functions.median import group_median, group_medians
from resalekit.functions.numeric import round_half_up, year_of
from resalekit.functions.text import map_labels
from resalekit.operators.ranking import top_groups

AREA = ["postcode_area", "postcode_area_name", "region", "country"]
# Medians of 2-dp money are exact at 3 dp (the mean of two 2-dp values).
MEDIAN_DIGITS = 3


def _year_filter(date: str, years: Sequence[int]) -> Column:
    """year(date) IN years, plus the equivalent date range so a stored,
    date-sorted or date-partitioned table can be pruned by its statistics."""
    lo, hi = min(years), max(years)
    d = F.col(date)
    in_range = (d >= F.lit(_dt.date(lo, 1, 1))) & (d <= F.lit(_dt.date(hi, 12, 31)))
    return in_range & year_of(d).isin(list(years))


def period_growth(h: DataFrame, years: tuple[int, int] = (2013, 2023),
                  by: Sequence[str] = AREA, *, min_count: int = 10,
                  date: str = "sale_date", price: str = "sale_price") -> DataFrame:
    """Per group, median price and row count in year A and in year B side
    by side, and growth (B - A) / A as a fraction (3 dp); groups need
    >= ``min_count`` rows (NULL prices included) in both years."""
    a, b = years
    by = list(by)
    rows = h.where(_year_filter(date, years)).select(*by, year_of(date).alias("_y"), price)
    # a year's median and count are conditional counts of one grouping: no pivot
    med = group_medians(rows, by, price, {f"_m{y}": F.col("_y") == y for y in (a, b)})
    growth = round_half_up((F.col(f"_m{b}") - F.col(f"_m{a}")) / F.nullif(F.col(f"_m{a}"), F.lit(0.0)), 3)
    return (med.where(F.col(f"_m{a}").isNotNull() & F.col(f"_m{b}").isNotNull()
                      & (F.col(f"_m{a}_count") >= min_count) & (F.col(f"_m{b}_count") >= min_count))
            .select(*by, *[round_half_up(f"_m{y}", MEDIAN_DIGITS).alias(f"median_price_{y}") for y in (a, b)],
                    *[F.col(f"_m{y}_count").alias(f"sales_count_{y}") for y in (a, b)], growth.alias("percent_change")))


def growth_long(wide: DataFrame, years: tuple[int, int] = (2013, 2023),
                by: Sequence[str] = AREA) -> DataFrame:
    """One row per group and year (single pass with ``stack``), ordered
    by growth (largest first), group, year."""
    a, b = years
    by = list(by)
    stacked = wide.select(*by, "percent_change", F.expr(
        f"stack(2, {int(a)}, median_price_{a}, sales_count_{a}, "
        f"{int(b)}, median_price_{b}, sales_count_{b}) AS (sale_year, median_price, sales_count)"))
    return (stacked.select(*by, F.col("sale_year").cast("int").alias("sale_year"), "median_price",
                           "sales_count", "percent_change")
            .orderBy(F.col("percent_change").desc_nulls_first(), F.col(by[0]).asc_nulls_last(), "sale_year"))


def segment_premium(h: DataFrame, flag: str = "new_build_at_sale",
                    by: Sequence[str] = ("postcode_area", "postcode_area_name"), *,
                    area_name: str | None = None, date: str = "sale_date",
                    price: str = "sale_price", segment: str = "property_type") -> DataFrame:
    """Per group x year x segment, the median price and count with the
    flag true and false, the difference and the total; only where both
    medians exist. ``area_name`` filters one area (applied before the
    aggregation; same rows as filtering after it) of the last column of ``by``."""
    by = list(by)
    rows = h.where(F.col(price).isNotNull() & F.col(flag).isNotNull())
    if area_name is not None:
        rows = rows.where(F.col(by[-1]) == F.lit(area_name))
    rows = rows.select(*by, year_of(date).alias("sale_year"), segment, flag, price)
    keys = by + ["sale_year", segment]
    med = group_medians(rows, keys, price, {"_new": F.col(flag), "_old": ~F.col(flag)})
    return (med.where(F.col("_new").isNotNull() & F.col("_old").isNotNull())
            .select(*by, "sale_year", segment,
                    round_half_up("_old", MEDIAN_DIGITS).alias("median_price_not_new"),
                    round_half_up("_new", MEDIAN_DIGITS).alias("median_price_new"),
                    round_half_up(F.col("_new") - F.col("_old"), MEDIAN_DIGITS).alias("median_price_diff"),
                    F.col("_old_count").alias("sales_count_not_new"), F.col("_new_count").alias("sales_count_new"),
                    (F.col("_new_count") + F.col("_old_count")).alias("sales_count_total"))
            .orderBy(*[F.col(c).asc_nulls_last() for c in by], "sale_year"))


# Printed tenure categories (anything else prints 'Unknown').
TENURE_LABELS = {"Freehold": "Freehold", "Leasehold": "Leasehold"}


def segment_median(h: DataFrame, by: Sequence[str] = ("postcode_area", "postcode_area_name"),
                   segment: str = "tenure", labels: Mapping[str, str] = TENURE_LABELS, *,
                   price: str = "sale_price", label_alias: str = "tenure_category",
                   collapse: bool = False) -> DataFrame:
    """Median price and count per group x *raw* segment value, printed
    through ``labels`` (so two raw values can print the same label on two
    rows); ``collapse=True`` groups by the printed label instead."""
    by = list(by)
    rows = h.where(F.col(price).isNotNull() & F.col(by[0]).isNotNull())
    label = map_labels(segment, dict(labels))
    if collapse:
        rows = rows.select(*by, label.alias(label_alias), price)
        med = group_median(rows, by + [label_alias], price, "_m", count_alias="sales_count")
        out = med.select(*by, "_m", label_alias, "sales_count")
        order = by + [label_alias]
    else:
        rows = rows.select(*by, segment, price)
        med = group_median(rows, by + [segment], price, "_m", count_alias="sales_count")
        out = med.select(*by, "_m", label.alias(label_alias), "sales_count", segment)
        order = [by[0], segment]
    out = out.select("*", round_half_up("_m", MEDIAN_DIGITS).alias("median_sale_price"))
    return (out.orderBy(*[F.col(c).asc_nulls_last() for c in order])
            .select(*by, "median_sale_price", label_alias, "sales_count"))


def _shock_years(shocks: Sequence[int]) -> list[int]:
    return sorted({y for s in shocks for y in (s - 1, s, s + 1)})


def busiest_areas(h: DataFrame, shocks: Sequence[int] = (2008, 2020), n: int = 6, *,
                  area: str = "postcode_area", date: str = "sale_date",
                  price: str = "sale_price") -> DataFrame:
    """The n areas with the most priced sales in the shock windows."""
    years = _shock_years(shocks)
    cond = _year_filter(date, years) & F.col(area).isNotNull() & F.col(price).isNotNull()
    return top_groups(h, area, n, where=cond)


def shock_windows(h: DataFrame, shocks: Sequence[int] = (2008, 2020), n_areas: int = 6, *,
                  date: str = "sale_date", price: str = "sale_price",
                  by: Sequence[str] = ("postcode_area", "postcode_area_name")) -> DataFrame:
    """For the busiest areas (first column of ``by``), median price and count
    per area x year in each shock window (year before, shock year, year after), with the
    before/after medians of the window on every row and the % change from
    before to after (1 dp).

    The counts per area and year that the medians come with also tell the busiest areas."""
    by, area = list(by), by[0]
    cond = _year_filter(date, _shock_years(shocks)) & F.col(area).isNotNull() & F.col(price).isNotNull()
    sales = h.where(cond).select(*by, year_of(date).alias("sale_year"), price)
    med = group_median(sales, by + ["sale_year"], price, "_m", count_alias="sales_count")
    top = med.groupBy(area).agg(F.sum("sales_count").alias("_n")).orderBy(
        F.col("_n").desc(), F.col(area).asc_nulls_last()).limit(n_areas).select(area)
    med = med.join(F.broadcast(top), area, "left_semi")  # n_areas rows
    y = F.col("sale_year")
    shock = F.coalesce(*[F.when(y.between(s - 1, s + 1), F.lit(s)) for s in shocks])
    role = F.element_at(F.array(*map(F.lit, ("Before", "Shock", "After"))), y - F.col("shock_year") + 2)
    labeled = med.select(*by, "sale_year", "_m", "sales_count", shock.alias("shock_year")).withColumn("year_role", role)
    # Window over <= 3 area-year rows per (area, shock): bounded.
    w = Window.partitionBy(area, "shock_year")
    of = lambda r: F.max(F.when(F.col("year_role") == r, F.col("_m"))).over(w)
    out = labeled.select("*", of("Before").alias("_b"), of("After").alias("_a"))
    pct = round_half_up(F.lit(100.0) * (F.col("_a") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0)), 1)
    return (out.select(*by, "sale_year", round_half_up("_m", MEDIAN_DIGITS).alias("median_price"), "sales_count",
                       "shock_year", "year_role", round_half_up("_b", MEDIAN_DIGITS).alias("median_price_before"),
                       round_half_up("_a", MEDIAN_DIGITS).alias("median_price_after"), pct.alias("pct_change_before_to_after"))
            .orderBy(F.col("shock_year").asc_nulls_last(), area, "sale_year"))
