"""Quick resales (W20-W23): share of entities resold within N years and the
median gain of those quick resale events.

Plan: one window pass per entity (LEAD date and price, plus entity-wide
flags over the same partition, so no second sort and no join back), then
one aggregate per entity on the same partitioning (no exchange), then one
shuffle by the four group keys. The gain medians of all windows are conditional
counts in the same two passes (``group_medians``); no row is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalekit.functions.median import group_medians
from resalekit.functions.numeric import days_between, pct_change, round_half_up, years_between
from resalekit.functions.text import label_or_unknown

GROUP = ["property_type", "postcode_area", "postcode_area_name", "tenure"]


def _prepared(h: DataFrame, key: str, date: str, price: str) -> DataFrame:
    """Rows usable for resale analysis: key, date, price, area and area name
    present; type and tenure trimmed, blank or NULL -> 'Unknown'."""
    needed = [key, date, price, "postcode_area", "postcode_area_name"]
    return (h.dropna(subset=needed)
            .select(F.col(key).alias("property_id"),
                    label_or_unknown("property_type", blank_is_unknown=True).alias("property_type"),
                    "postcode_area", "postcode_area_name",
                    label_or_unknown("tenure", blank_is_unknown=True).alias("tenure"),
                    F.col(date).alias("sale_date"), F.col(price).alias("sale_price")))


def quick_events(h: DataFrame, *, key: str = "property_id", max_years=(2, 5),
                 min_days: int = 7, date: str = "sale_date", price: str = "sale_price") -> DataFrame:
    """Event-level frame: every sale with its next sale, the gap in days and
    years, the % gain rounded to 1 dp, and entity-wide flags
    (``_has_next``, ``_has_q{n}``) computed over the same window partition."""
    p = _prepared(h, key, date, price)
    by_date = Window.partitionBy("property_id").orderBy("sale_date")
    whole = Window.partitionBy("property_id")
    ev = p.select("*", F.lead("sale_date").over(by_date).alias("next_sale_date"),
                  F.lead("sale_price").over(by_date).alias("next_sale_price"))
    is_pair = F.col("next_sale_date").isNotNull() & F.col("next_sale_price").isNotNull()
    ev = ev.select(
        "*", is_pair.alias("_pair"),
        years_between("next_sale_date", "sale_date").alias("years_to_next_sale"),
        days_between("next_sale_date", "sale_date").alias("days_to_next_sale"),
        round_half_up(pct_change("next_sale_price", "sale_price"), 1).alias("pct_gain"))
    quick = F.col("_pair") & (F.col("days_to_next_sale") >= F.lit(min_days))
    flags = [F.max(F.col("_pair")).over(whole).alias("_has_next"),
             F.max(quick.cast("int")).over(whole).alias("_has_quick")]
    for n in max_years:
        flags.append(F.max((quick & (F.col("years_to_next_sale") <= F.lit(n))).cast("int"))
                     .over(whole).alias(f"_has_q{n}"))
    return ev.select("*", quick.alias("_quick"), *flags)


def quick_flags(h: DataFrame, *, key: str = "property_id", max_years=(2, 5),
                min_days: int = 7) -> DataFrame:
    """One row per entity with at least one quick event (gap >= min_days):
    property_id, has_quick_{n}y (1/0) per window."""
    ev = quick_events(h, key=key, max_years=max_years, min_days=min_days)
    out = ev.where(F.col("_has_quick") == 1).groupBy("property_id").agg(
        *[F.max(f"_has_q{n}").alias(f"has_quick_{n}y") for n in max_years])
    return out.orderBy("property_id")


def _entity_rows(ev: DataFrame, max_years) -> DataFrame:
    """DISTINCT (entity, type, area, name, tenure) with the entity's flags;
    grouped on the window's partitioning, so no exchange is added."""
    return ev.groupBy("property_id", *GROUP).agg(
        F.max(F.col("_has_next").cast("int")).alias("_two_plus"),
        *[F.max(f"_has_q{n}").alias(f"_q{n}") for n in max_years])


def quick_shares(h: DataFrame, *, key: str = "property_id", max_years=(2, 5),
                 min_days: int = 7) -> DataFrame:
    """Per type x area x area name x tenure: entity counts, entities with
    2+ sales, entities with a quick resale per window, and their shares of
    all entities and of 2+ sale entities (4 dp)."""
    return _shares(quick_events(h, key=key, max_years=max_years, min_days=min_days), max_years)


def _shares(ev: DataFrame, max_years) -> DataFrame:
    ent = _entity_rows(ev, max_years)
    total = F.count(F.lit(1))
    two_plus = F.sum("_two_plus")
    aggs = [total.alias("properties_total"), two_plus.alias("properties_2plus_sales")]
    aggs += [F.sum(f"_q{n}").alias(f"properties_quick_{n}y") for n in max_years]
    out = ent.groupBy(*GROUP).agg(*aggs)
    shares = []
    for n in max_years:
        shares.append(round_half_up(F.col(f"properties_quick_{n}y") /
                                    F.nullif(F.col("properties_total"), F.lit(0)), 4)
                      .alias(f"share_quick_{n}y_all"))
    for n in max_years:
        shares.append(round_half_up(F.col(f"properties_quick_{n}y") /
                                    F.nullif(F.col("properties_2plus_sales"), F.lit(0)), 4)
                      .alias(f"share_quick_{n}y_2plus"))
    return out.select("*", *shares)


def quick_gains(h: DataFrame, *, key: str = "property_id", max_years=(2, 5),
                min_days: int = 7, floor: float = 10000, digits: int | None = 3) -> DataFrame:
    """Per group having a quick event: number of quick events within each
    window whose starting price is >= floor, and their median % gain
    (gains are rounded to 1 dp before the median). Medians are rounded to
    ``digits`` (3 keeps every digit a median of 1-dp values can have)."""
    return _gains(quick_events(h, key=key, max_years=max_years, min_days=min_days),
                  max_years, floor, digits)


def _gains(ev: DataFrame, max_years, floor: float, digits: int | None) -> DataFrame:
    base = F.col("sale_price") >= F.lit(floor)
    med = group_medians(ev.where(F.col("_quick")), GROUP, "pct_gain",
                        {f"median_pct_gain_{n}y": base & (F.col("years_to_next_sale") <= F.lit(n)) for n in max_years})
    cols = []
    for n in max_years:
        m = f"median_pct_gain_{n}y"
        cols += [F.col(f"{m}_count").alias(f"quick_events_{n}y"),
                 (round_half_up(m, digits) if digits is not None else F.col(m)).alias(m)]
    return med.select(*GROUP, *cols)


def quick_resale_summary(h: DataFrame, *, key: str = "property_id", max_years=(2, 5),
                         min_days: int = 7, floor: float = 10000) -> DataFrame:
    """W21 shares with W22 counts (0 when none) and medians (1 dp),
    ordered by area, tenure, type."""
    ev = quick_events(h, key=key, max_years=max_years, min_days=min_days)
    shares = _shares(ev, max_years)
    gains = _gains(ev, max_years, floor, None)
    out = shares.join(gains, GROUP, "left")
    measures = [c for c in shares.columns if c not in GROUP]
    tail = []
    for n in max_years:
        tail.append(F.coalesce(F.col(f"quick_events_{n}y"), F.lit(0)).cast("long").alias(f"quick_events_{n}y"))
        tail.append(round_half_up(f"median_pct_gain_{n}y", 1).alias(f"median_pct_gain_{n}y"))
    return (out.select("postcode_area", "postcode_area_name", "tenure", "property_type",
                       *measures, *tail)
            .orderBy("postcode_area", "tenure", "property_type"))
