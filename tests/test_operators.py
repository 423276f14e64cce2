import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from resalekit.operators import checks, clean, enrich, history, holding, quick, ranking, segments
from resalekit.sources import schemas

D = dt.date


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


# --- cleaning ----------------------------------------------------------------

def test_clean_events_dedup_and_null_flag_wins(raw_events):
    ce = clean.clean_events(raw_events, on_error="null")
    got = {(r.property_id, r.sale_date): (r.sale_price, r.new_build_at_sale) for r in ce.collect()}
    assert len(got) == 16
    assert float(got[(1, D(2001, 1, 1))][0]) == 120000 and got[(1, D(2001, 1, 1))][1] is False
    assert float(got[(2, D(2002, 5, 5))][0]) == 90000 and got[(2, D(2002, 5, 5))][1] is None
    assert got[(4, D(2008, 1, 1))][0] is None
    assert not any(k[0] == 5 for k in got)
    assert checks.grain_violations(ce).collect()[0].violations == 0


def test_clean_events_strict_mode_raises(spark):
    bad = spark.createDataFrame([(1, "2001-01-01", "£1.2.3", True)], schemas.RAW_EVENTS)
    with pytest.raises(Exception):
        clean.clean_events(bad).collect()


def test_clean_events_with_unreadable_dates(spark):
    rows = [(1, "03/01/1995", "£10,000", True), (1, "04/01/1996", "£20,000", True), (1, "1999-01-01", "£30,000", True)]
    raw = spark.createDataFrame(rows, schemas.RAW_EVENTS)
    with pytest.raises(Exception):
        clean.clean_events(raw, date_formats=["yyyy-MM-dd"]).collect()
    lenient = clean.clean_events(raw, date_formats=["yyyy-MM-dd"], on_error="null").collect()
    assert [(r.sale_date, float(r.sale_price)) for r in lenient] == [(D(1999, 1, 1), 30000.0)]
    both = clean.clean_events(raw, date_formats=["yyyy-MM-dd", "dd/MM/yyyy"]).collect()
    assert {float(r.sale_price) for r in both} == {10000.0, 20000.0, 30000.0}


def test_hot_entity_is_cut_before_the_shuffle(spark):
    """A key with a third of all rows, most of them on one day: copies do not move."""
    hot = spark.range(10000).selectExpr("1L AS property_id", "'2001-01-01' AS deedDate", "'£1' AS displayPrice", "true AS newBuild")
    rest = spark.range(2, 20002).selectExpr("id AS property_id", "'2001-01-01' AS deedDate", "'£1' AS displayPrice", "true AS newBuild")
    out = clean.clean_events(hot.unionByName(rest))
    assert out.count() == 20001
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    ex = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in plan[ex + 1:])


def test_null_key_is_an_entity_of_the_guarded_metrics_only(spark):
    rows = [(None, D(2001, 1, 1), 100.0), (None, D(2003, 1, 1), 150.0), (1, D(2001, 1, 1), 100.0), (1, D(2003, 1, 1), 150.0)]
    df = spark.createDataFrame(rows, "property_id long, sale_date date, sale_price double")
    for c in ("property_type", "tenure", "region", "postcode_area", "postcode_area_name"):
        df = df.withColumn(c, F.lit("x"))
    assert {r.property_id for r in holding.guarded_metrics(df).collect()} == {None, 1}
    assert {r.property_id for r in holding.holding_metrics(df).collect()} == {1}


def test_clean_entities(raw_entities):
    ce = rows_by(clean.clean_entities(raw_entities, on_error="null"), "property_id")
    assert (ce[1].postcode, ce[1].postcode_area) == ("SW7 1RH", "SW7")
    assert (ce[2].postcode, ce[2].postcode_area) == ("SW71RH", "SW71RH")
    assert ce[4].postcode is None and ce[4].latest_sale_price is None
    assert ce[8].postcode_area == "EC1A"
    assert ce[1].latest_price_raw == "£1,000" and float(ce[1].latest_sale_price) == 1000


# --- checks ------------------------------------------------------------------

def test_profile_checks(spark, raw_events, raw_entities):
    rc = {r.table_name: r.rows for r in checks.row_counts(
        {"properties_main": raw_entities, "price_history": raw_events}).collect()}
    assert rc == {"properties_main": 9, "price_history": 19}
    dr = checks.date_range(raw_events).collect()[0]
    assert (dr.earliest_deedDate, dr.latest_deedDate) == (D(2001, 1, 1), D(2012, 1, 1))
    nm = checks.null_profile(raw_events, "total_rows", nonnull={"nonnull_dates": "deedDate"}).collect()[0]
    assert (nm.total_rows, nm.nonnull_dates) == (19, 18)
    per_year = {r.sale_year: r.sale_price for r in checks.events_per_year(raw_events).collect()}
    assert per_year[2010] == 5 and per_year[None] == 1


def test_orphans_both_ways(raw_events, raw_entities):
    assert checks.orphans(raw_events, raw_entities).collect()[0][0] == 1   # property 99
    assert checks.orphans(raw_entities, raw_events).collect()[0][0] == 1   # property 50


def test_duplicate_keys(raw_events):
    dup = checks.duplicate_keys(raw_events).collect()
    assert {(r.property_id, r.sale_date, r["count"]) for r in dup} == {
        (1, "2001-01-01", 2), (2, "2002-05-05", 2)}


def test_clean_null_checks_and_coverage(raw_entities):
    ce = clean.clean_entities(raw_entities, on_error="null")
    r = checks.clean_null_checks(ce).collect()[0]
    assert (r.null_postcode, r.null_latest_sale_price, r.missing_latest_sale_date) == (1, 1, 0)
    c = checks.postcode_coverage(raw_entities).collect()[0]
    assert (c.total_rows, c.postcode_found) == (9, 8)


def test_assert_unique_rejects_duplicate_geo_key(spark, raw_events, raw_entities, geo):
    dup = geo.unionByName(spark.createDataFrame([("sw7", "SW", "x", "y", "z")], schemas.GEO_MAP))
    with pytest.raises(ValueError):
        enrich.enrich(clean.clean_events(raw_events, on_error="null"),
                      clean.clean_entities(raw_entities, on_error="null"), dup, check_keys=True)


# --- enrichment --------------------------------------------------------------

def test_enrich_keeps_every_event_and_labels_unknowns(enriched):
    rows = enriched.collect()
    assert len(rows) == 16
    by_id = {}
    for r in rows:
        by_id.setdefault(r.property_id, r)
    assert by_id[1].postcode_area == "SW" and by_id[3].postcode_area_name == "Manchester"
    assert by_id[2].postcode_area is None          # unspaced postcode misses the map
    assert by_id[8].postcode_area is None          # district absent from the map
    assert by_id[99].property_type == "Unknown" and by_id[99].tenure == "Unknown"
    assert by_id[4].property_type == "Unknown"
    assert by_id[7].property_type == "  " and by_id[7].tenure == ""


# --- consecutive events ------------------------------------------------------

def test_consecutive_change_floor_before_lag(enriched):
    out = rows_by(history.consecutive_change(enriched, ["property_type"]), "property_type")
    assert out["Flat"].median_percent_price_change == 15.3 and out["Flat"].resale_events_used == 2
    assert out["Terraced"].median_percent_price_change == 20.0   # 5,000 sale skipped
    assert out["Detached"].median_percent_price_change == 900.0
    assert out["Unknown"].median_percent_price_change == -12.5


def test_time_to_next(enriched):
    out = {(r.property_type, r.postcode_area): r for r in history.time_to_next(enriched).collect()}
    assert out[("Flat", "SW")].median_years_to_next_sale == 2.0
    assert out[("Terraced", "M")].resale_pairs_count == 2
    assert out[("Unknown", None)].resale_pairs_count == 2   # NULL price rows still pair up


# --- quick resales -----------------------------------------------------------

def test_quick_flags_exclude_short_gaps_and_unmapped(enriched):
    flags = rows_by(quick.quick_flags(enriched), "property_id")
    assert set(flags) == {1, 3, 7}
    assert (flags[1].has_quick_2y, flags[1].has_quick_5y) == (1, 1)


def test_quick_shares_and_summary(enriched):
    sh = {(r.property_type, r.tenure): r for r in quick.quick_shares(enriched).collect()}
    assert set(sh) == {("Flat", "Leasehold"), ("Terraced", "Feudal"), ("Detached", "Freehold"),
                       ("Unknown", "Unknown")}
    d = sh[("Detached", "Freehold")]
    assert (d.properties_total, d.properties_2plus_sales, d.properties_quick_2y) == (1, 1, 0)
    assert d.share_quick_2y_all == 0.0
    sm = {(r.property_type, r.tenure): r for r in quick.quick_resale_summary(enriched).collect()}
    assert sm[("Flat", "Leasehold")].quick_events_2y == 1
    assert sm[("Flat", "Leasehold")].median_pct_gain_2y == 25.0
    assert sm[("Detached", "Freehold")].quick_events_2y == 0
    assert sm[("Detached", "Freehold")].median_pct_gain_2y is None
    t = sm[("Terraced", "Feudal")]   # 5,000 start price is below the floor
    assert t.quick_events_5y == 1 and t.median_pct_gain_5y == 20.0


# --- holding returns ---------------------------------------------------------

def test_holding_metrics_edge_cases(enriched):
    m = rows_by(holding.review_flag(holding.holding_metrics(enriched)), "property_id")
    assert float(m[4].first_price) == 80000 and m[4].sales_count == 2   # NULL price dropped first
    assert math.isinf(m[6].annualized_return_raw)                       # overflow kept as +inf
    assert m[6].review_flag == "Short hold (<1 year)"
    assert m[7].years_tracked == 1.0 and m[7].review_flag is None       # 364 days rounds to 1.00
    assert m[3].review_flag.startswith("Below")
    assert 8 not in m and 99 not in m


def test_guarded_metrics_keep_null_prices(enriched):
    g = rows_by(holding.guarded_metrics(enriched), "property_id")
    assert g[4].first_recorded_price is None and g[4].count_recorded_sales == 3
    assert g[4].annualized_return is None and g[4].pct_gain is None
    assert g[6].annualized_return is None and g[6].hold_flag == "Short hold (<90 days)"
    assert g[7].hold_flag == "Normal hold (90+ days)" and g[7].days_held == 364


def test_retention_funnel_is_monotone(enriched):
    r = holding.retention(holding.guarded_metrics(enriched)).collect()[0]
    assert (r.total_eligible, r.after_90_day_rule, r.after_90_day_and_25_cap) == (4, 2, 2)
    assert (r.pct_remaining_after_90_day_rule, r.pct_remaining_after_25_cap_of_90plus,
            r.pct_remaining_after_both_filters) == (50.0, 100.0, 50.0)


# --- rankings ----------------------------------------------------------------

def test_two_sided_dense_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 5, 4, 3, 2, 1, 1, 0])],
                               "property_id long, m double")
    out = {r.property_id: (r.bucket, r.rank_in_bucket) for r in ranking.two_sided_dense(df, "m", 2).collect()}
    assert out == {0: ("Winner", 1), 1: ("Winner", 1), 2: ("Winner", 2),
                   7: ("Loser", 1), 5: ("Loser", 2), 6: ("Loser", 2)}


def test_two_sided_limit_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, None if v is None else float(v))
                                for i, v in enumerate([9, 9, 9, 1, None])],
                               "property_id long, m double")
    out = ranking.two_sided_limit(df, "m", 2).collect()
    # top 2: ids 0, 1; bottom 2: id 3 (1.0) then id 0 (lowest key among the 9s)
    assert [(r.property_id, r.category) for r in out] == [
        (0, "Loser"), (0, "Winner"), (1, "Winner"), (3, "Loser")]


def test_two_sided_dense_plan_has_no_full_single_partition(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("property_id"), (F.col("id") % 37).cast("double").alias("m"))
    plan = ranking.two_sided_dense(df, "m", 3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = "\n".join(lines[i:i + 3])
            assert "TakeOrderedAndProject" in below or "Limit" in below


# --- segments ----------------------------------------------------------------

def test_segment_median_raw_tenure_two_unknown_rows(enriched):
    rows = segments.segment_median(enriched).collect()
    m_rows = [r for r in rows if r.postcode_area == "M"]
    assert sorted(r.tenure_category for r in m_rows) == ["Freehold", "Unknown", "Unknown"]
    collapsed = segments.segment_median(enriched, collapse=True).collect()
    assert sorted(r.tenure_category for r in collapsed if r.postcode_area == "M") == ["Freehold", "Unknown"]


def test_period_growth_counts_null_area_and_null_prices(spark):
    rows = []
    for y, base in ((2013, 100.0), (2023, 150.0)):
        for i in range(10):
            rows.append((None, None, None, None, D(y, 3, 1 + i), None if i == 0 else base))
    df = spark.createDataFrame(rows, "postcode_area string, postcode_area_name string, region string, "
                                     "country string, sale_date date, sale_price double")
    wide = segments.period_growth(df).collect()
    assert len(wide) == 1 and wide[0].sales_count_2013 == 10 and wide[0].percent_change == 0.5
    long = segments.growth_long(segments.period_growth(df)).collect()
    assert [r.sale_year for r in long] == [2013, 2023]


def test_shock_windows_before_after(spark):
    rows = []
    for area, scale in (("A", 1.0), ("B", 2.0), ("C", 1.0)):
        n = 5 if area != "C" else 1
        for y, p in ((2007, 100.0), (2008, 90.0), (2009, 110.0)):
            for _ in range(n):
                rows.append((area, area + "name", D(y, 6, 1), p * scale))
    df = spark.createDataFrame(rows, "postcode_area string, postcode_area_name string, sale_date date, sale_price double")
    top = [r.postcode_area for r in segments.busiest_areas(df, (2008,), 2).collect()]
    assert top == ["A", "B"]
    out = segments.shock_windows(df, (2008,), 2).collect()
    assert {r.postcode_area for r in out} == {"A", "B"}
    a = [r for r in out if r.postcode_area == "A"]
    assert {r.year_role for r in a} == {"Before", "Shock", "After"}
    assert all(r.pct_change_before_to_after == 10.0 for r in a)
    assert all(r.median_price_before == 100.0 and r.median_price_after == 110.0 for r in a)


def test_segment_premium_needs_both_flags(spark):
    rows = [("M", "Manchester", D(2010, 1, 1), "Flat", True, 200.0),
            ("M", "Manchester", D(2010, 2, 1), "Flat", False, 100.0),
            ("M", "Manchester", D(2010, 3, 1), "Flat", None, 999.0),
            ("M", "Manchester", D(2011, 1, 1), "Flat", True, 300.0)]
    df = spark.createDataFrame(rows, "postcode_area string, postcode_area_name string, sale_date date, "
                                     "property_type string, new_build_at_sale boolean, sale_price double")
    out = segments.segment_premium(df, area_name="Manchester").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.sale_year, r.median_price_new, r.median_price_not_new, r.median_price_diff) == (2010, 200.0, 100.0, 100.0)
    assert (r.sales_count_new, r.sales_count_not_new, r.sales_count_total) == (1, 1, 2)


def test_dedup_limits_groups_before_the_shuffle(raw_events):
    plan = clean.clean_events(raw_events, on_error="null")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    ex = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines[ex + 1:])


def test_compact_postcodes_and_the_match_report(raw_events, raw_entities, geo):
    from resalekit.operators.enrich import enrich, match_report
    events = clean.clean_events(raw_events, on_error="null")

    def report(**kw):
        rows = match_report(enrich(events, clean.clean_entities(raw_entities, on_error="null", **kw), geo)).collect()
        return {r.postcode_district: (r.sales_count, r.unmatched_count, r.pct_unmatched) for r in rows}

    spaced, compact = report(), report(compact_postcodes=True)
    # entity 2 is at SW71RH: two events
    assert spaced["SW71RH"] == (2, 2, 100.0) and "SW71RH" not in compact
    assert compact["SW7"] == (spaced["SW7"][0] + 2, 0, 0.0) and spaced["SW7"][1] == 0
    assert spaced["EC1A"] == compact["EC1A"] == (1, 1, 100.0)  # not in the map
    assert spaced[None] == compact[None] and spaced[None][2] == 100.0
    assert sum(v[0] for v in spaced.values()) == events.count()
