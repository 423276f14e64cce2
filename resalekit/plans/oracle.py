"""DuckDB SQL for every pipeline, over the driver's tables.

The texts reach each result by another road than the pipelines: ordered
aggregates (``first(x ORDER BY ...)``) in place of windows for deduplication and
for first and last events, one conditional aggregate (``FILTER``) in place of
pivots and joins, and ranks made from distinct values. They share with the
pipelines only column names, labels, the postcode pattern and the parameters.
"""

from __future__ import annotations

from resalekit.functions.text import POSTCODE_PATTERN
from resalekit.operators import holding
from resalekit.plans.params import Params

P = Params()
YA, YB = P.growth_years


def rnd(x: str, digits: int) -> str:
    """Half away from zero on the decimal value; beyond its range as it is."""
    return (f"if(abs({x}) < 1e27, round(({x})::DECIMAL(38,10), {digits})::DOUBLE, ({x})::DOUBLE)")


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def mid(x: str, where: str = "true") -> str:
    """Exact median of the rows that ``where`` picks."""
    return f"quantile_cont(({x})::DOUBLE, 0.5) FILTER (WHERE {where})"


MONEY = "nullif(regexp_replace({}, '[^0-9.]', '', 'g'), '')::DECIMAL(18,2)"

# The raw shapes, made of the driver's tables (see sources/bindings.py).
RAW = f"""raw_events AS (
  SELECT if(o_orderkey % 211 = 0, -o_custkey, o_custkey) AS id,
         if(o_orderkey % 97 = 0, NULL, strftime(o_orderdate, '%Y-%m-%d')) AS day_text,
         if(o_orderkey % 89 = 0, 'POA', format('£{{:,.2f}}', o_totalprice)) AS price_text,
         if(o_orderstatus IN ('O', 'F'), o_orderstatus = 'O', NULL) AS flag
  FROM orders),
raw_entities AS (
  SELECT if(c_custkey % 53 = 0, -c_custkey, c_custkey) AS id,
         c_custkey || ' Test Road' || if(c_custkey % 71 = 0, '',
           ', ' || chr((97 + c_nationkey)::INT) || (c_custkey % 9 + 1) || if(c_custkey % 50 = 0, '', ' ')
                || (c_custkey % 7 + 1) || 'aa') AS address,
         if(c_custkey % 40 = 0, NULL, c_mktsegment) AS kind,
         if(c_custkey % 3 = 0, NULL, 'sub' || (c_custkey % 4)) AS subkind,
         (c_custkey % 6)::INT AS beds, (c_custkey % 3)::INT AS baths,
         ['Leasehold', 'Freehold', 'Freehold', 'Feudal', NULL][c_custkey % 5 + 1] AS tenure,
         format('£{{:,.2f}}', c_acctbal) AS price_text,
         strftime(DATE '1999-01-01' + (c_custkey % 900)::INT, '%Y-%m-%d') AS day_text,
         c_custkey % 10 = 0 AS flag
  FROM customer),
districts AS (
  SELECT chr((65 + n_nationkey)::INT) || i AS district, chr((65 + n_nationkey)::INT) AS area, n_name AS area_name,
         r_name AS region, 'C' || (r_regionkey % 2) AS country
  FROM nation JOIN region ON r_regionkey = n_regionkey, range(1, 9) AS r(i))"""

CLEAN = f"""events AS (
  SELECT id, day, first(price ORDER BY price DESC NULLS LAST, flag DESC NULLS FIRST) AS price,
         first(flag ORDER BY price DESC NULLS LAST, flag DESC NULLS FIRST) AS flag
  FROM (SELECT id, day_text::DATE AS day, {MONEY.format('price_text')} AS price, flag FROM raw_events)
  WHERE day IS NOT NULL GROUP BY id, day),
entities AS (
  SELECT *, nullif(regexp_extract(upper(address), '{POSTCODE_PATTERN}', 1), '') AS code FROM raw_entities)"""

SALES = """sales AS (
  SELECT v.id, v.day, v.price, v.flag, e.address, e.code, string_split(e.code, ' ')[1] AS district,
         ifnull(e.kind, 'Unknown') AS kind, ifnull(e.subkind, 'Unknown') AS subkind, e.beds, e.baths,
         ifnull(e.tenure, 'Unknown') AS tenure, e.flag AS entity_flag, g.area, g.area_name, g.region, g.country,
         year(v.day)::INT AS yr
  FROM events v LEFT JOIN entities e USING (id) LEFT JOIN districts g ON g.district = string_split(e.code, ' ')[1])"""


def q(body: str, *steps: str, start: tuple[str, ...] = (RAW, CLEAN, SALES)) -> str:
    return "WITH " + ",\n".join((*start, *steps)) + "\n" + body.strip()


def raw(body: str) -> str:
    return q(body, start=(RAW,))


def clean(body: str) -> str:
    return q(body, start=(RAW, CLEAN))


# --- consecutive sales ---------------------------------------------------------

CHANGES = f"""changes AS (
  SELECT *, {ratio('100 * (price - before)', 'before')} AS change
  FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY day) AS before FROM sales WHERE price >= {P.floor})
  WHERE before IS NOT NULL)"""


def change(keys: dict[str, str]) -> str:
    named = ", ".join(f"{a} AS {b}" for a, b in keys.items())
    return q(f"""SELECT {named}, {rnd(mid('change'), 1)} AS median_percent_price_change, count(*) AS resale_events_used
FROM changes GROUP BY ALL""", CHANGES)


# --- quick resales ---------------------------------------------------------------

SHORT, LONG = P.quick_years
GAPS = f"""gaps AS (
  SELECT id, coalesce(nullif(trim(kind), ''), 'Unknown') AS property_type, area AS postcode_area, area_name AS postcode_area_name,
         coalesce(nullif(trim(tenure), ''), 'Unknown') AS tenure, price,
         lead(day) OVER e - day AS days, lead(price) OVER e AS next_price
  FROM sales WHERE id IS NOT NULL AND price IS NOT NULL AND area IS NOT NULL AND area_name IS NOT NULL
  WINDOW e AS (PARTITION BY id ORDER BY day)),
resales AS (
  SELECT *, days >= {P.quick_min_days} AS ok, ok AND days / 365.25 <= {SHORT} AS short, ok AND days / 365.25 <= {LONG} AS long,
         {rnd(ratio('100 * (next_price - price)', 'price'), 1)} AS gain,
         bool_or(days IS NOT NULL) OVER o AS any_next, bool_or(coalesce(short, false)) OVER o AS any_short,
         bool_or(coalesce(long, false)) OVER o AS any_long, bool_or(coalesce(ok, false)) OVER o AS any_ok
  FROM gaps WINDOW o AS (PARTITION BY id))"""
GROUP = "property_type, postcode_area, postcode_area_name, tenure"
COUNTS = f"""counts AS (
  SELECT {GROUP}, count(DISTINCT id) AS properties_total,
         count(DISTINCT id) FILTER (WHERE any_next) AS properties_2plus_sales,
         count(DISTINCT id) FILTER (WHERE any_short) AS properties_quick_{SHORT}y,
         count(DISTINCT id) FILTER (WHERE any_long) AS properties_quick_{LONG}y,
         count(*) FILTER (WHERE short AND price >= {P.floor}) AS quick_events_{SHORT}y, {mid('gain', f'short AND price >= {P.floor}')} AS m_short,
         count(*) FILTER (WHERE long AND price >= {P.floor}) AS quick_events_{LONG}y, {mid('gain', f'long AND price >= {P.floor}')} AS m_long,
         bool_or(ok) AS has_event
  FROM resales GROUP BY ALL)"""
SHARES = ", ".join(f"{rnd(ratio(f'properties_quick_{n}y', of), 4)} AS share_quick_{n}y_{name}"
                   for of, name in (("properties_total", "all"), ("properties_2plus_sales", "2plus")) for n in (SHORT, LONG))
TOTALS = f"properties_total, properties_2plus_sales, properties_quick_{SHORT}y, properties_quick_{LONG}y, {SHARES}"


def gains(digits: int) -> str:
    return (f"quick_events_{SHORT}y, {rnd('m_short', digits)} AS median_pct_gain_{SHORT}y, "
            f"quick_events_{LONG}y, {rnd('m_long', digits)} AS median_pct_gain_{LONG}y")


# --- holding returns ---------------------------------------------------------------

def held(where: str) -> str:
    """One row per entity: what its first and last events say."""
    last = ", ".join(f"first({c} ORDER BY day DESC) AS {n}" for c, n in (
        ("kind", "property_type"), ("tenure", "tenure"), ("region", "region"), ("area", "postcode_area"), ("area_name", "postcode_area_name")))
    return f"""held AS (
  SELECT id AS property_id, {last}, min(day) AS d1, max(day) AS d2, first(price ORDER BY day) AS p1,
         first(price ORDER BY day DESC) AS p2, count(*) AS n, d2 - d1 AS days
  FROM sales WHERE {where} GROUP BY id HAVING count(*) > 1 AND min(day) < max(day))"""


METRICS = f"""metrics AS (
  SELECT property_id, property_type, tenure, region, postcode_area, postcode_area_name, d1 AS first_date, p1 AS first_price,
         d2 AS last_date, p2 AS last_price, n AS sales_count, {rnd('days / 365.25::DOUBLE', 2)} AS years_tracked,
         {rnd(f"({ratio('p2', 'p1')} - 1) * 100", 2)} AS pct_change, (p2 - p1)::DECIMAL(18,2) AS absolute_gain,
         {rnd(f"(power({ratio('p2', 'p1')}, 1 / (days / 365.25::DOUBLE)) - 1) * 100", 2)} AS annualized_return_raw,
         if(p1 < {P.floor}, '{holding.LABEL_BELOW_FLOOR}', if(years_tracked < {P.short_years}, '{holding.LABEL_SHORT_HOLD_YEAR}',
           if(annualized_return_raw >= {P.cap}, '{holding.LABEL_EXTREME}', NULL))) AS review_flag
  FROM held)"""
PRICED = (held("id IS NOT NULL AND price IS NOT NULL"), METRICS)
GUARDED = (held("true"), f"""guarded AS (
  SELECT property_id, property_type, tenure, postcode_area_name, region, p1 AS first_recorded_price, d1 AS first_recorded_date,
         p2 AS last_recorded_price, d2 AS last_recorded_date, n AS count_recorded_sales,
         {rnd(f"({ratio('p2', 'p1')} - 1) * 100", 2)} AS pct_gain, {rnd('days / 365.25::DOUBLE', 3)} AS years_tracked,
         days::INT AS days_held,
         if(days >= {P.min_hold_days}, {rnd(f"(power({ratio('p2', 'p1')}, 365.25::DOUBLE / days) - 1) * 100", 2)}, NULL) AS annualized_return,
         if(days >= {P.min_hold_days}, '{holding.LABEL_NORMAL_HOLD}', '{holding.LABEL_SHORT_HOLD_DAYS}') AS hold_flag
  FROM held)""")
ELIGIBLE = f"first_recorded_price >= {P.floor} AND last_recorded_price >= {P.floor}"
HELD = f"{ELIGIBLE} AND days_held >= {P.min_hold_days}"
CAPPED = f"{HELD} AND annualized_return <= {P.cap}"

# --- segments ------------------------------------------------------------------------

AREA = "area AS postcode_area, area_name AS postcode_area_name"
GROWTH = f"""growth AS (
  SELECT {AREA}, region, country, {mid('price', f'yr = {YA}')} AS a, {mid('price', f'yr = {YB}')} AS b,
         count(*) FILTER (WHERE yr = {YA}) AS sales_count_{YA}, count(*) FILTER (WHERE yr = {YB}) AS sales_count_{YB},
         {rnd(ratio('b - a', 'a'), 3)} AS percent_change
  FROM sales WHERE yr IN ({YA}, {YB}) GROUP BY ALL
  HAVING a IS NOT NULL AND b IS NOT NULL AND sales_count_{YA} >= {P.min_count} AND sales_count_{YB} >= {P.min_count})"""
LONG_GROWTH = q(" UNION ALL ".join(f"""SELECT postcode_area, postcode_area_name, region, country, {y} AS sale_year,
  {rnd(m, 3)} AS median_price, sales_count_{y} AS sales_count, percent_change FROM growth
""" for y, m in ((YA, "a"), (YB, "b"))), GROWTH)


def premium(where: str) -> str:
    return q(f"""SELECT {AREA}, yr AS sale_year, kind AS property_type, {rnd('o', 3)} AS median_price_not_new,
  {rnd('w', 3)} AS median_price_new, {rnd('w - o', 3)} AS median_price_diff, sales_count_not_new, sales_count_new,
  sales_count_not_new + sales_count_new AS sales_count_total
FROM (SELECT area, area_name, yr, kind, {mid('price', 'flag')} AS w, {mid('price', 'NOT flag')} AS o,
        count(*) FILTER (WHERE flag) AS sales_count_new, count(*) FILTER (WHERE NOT flag) AS sales_count_not_new
      FROM sales WHERE price IS NOT NULL AND {where} GROUP BY ALL)
WHERE w IS NOT NULL AND o IS NOT NULL""")


SHOCK = f"""shock(s) AS (VALUES {', '.join(f'({s})' for s in P.shocks)}),
near AS (
  SELECT area, area_name, yr, min(s) AS s, {mid('price')} AS m, count(*) AS n
  FROM (SELECT area, area_name, yr, price, id, day, min(s) AS s FROM sales JOIN shock ON abs(yr - s) <= 1
        WHERE area IS NOT NULL AND price IS NOT NULL GROUP BY ALL) GROUP BY area, area_name, yr),
busy AS (SELECT area AS postcode_area, sum(n)::BIGINT AS sales_count FROM near GROUP BY ALL
         ORDER BY sales_count DESC, postcode_area LIMIT {P.n_areas})"""


def ends(metric: str) -> str:
    """Distinct values of a metric with their places from either end."""
    return f"""places AS (
  SELECT v, row_number() OVER (ORDER BY v DESC) AS high, row_number() OVER (ORDER BY v) AS low
  FROM (SELECT DISTINCT {metric} AS v FROM metrics WHERE first_price >= {P.floor} AND {metric} IS NOT NULL))"""


ORACLE: dict[str, str] = {
    "profile_row_counts": raw("""SELECT 'properties_main' AS table_name, (SELECT count(*) FROM raw_entities) AS rows
UNION ALL VALUES ('price_history', (SELECT count(*) FROM raw_events))"""),
    "profile_date_range": raw('SELECT min(day_text::DATE) AS "earliest_deedDate", max(day_text::DATE) AS "latest_deedDate" FROM raw_events'),
    "profile_events_per_year": raw("SELECT year(day_text::DATE)::INT AS sale_year, count(price_text) AS sale_price FROM raw_events GROUP BY ALL"),
    "profile_missing_dates": raw("SELECT count(*) AS total_rows, count(day_text) AS nonnull_dates FROM raw_events"),
    "orphan_events": raw("SELECT count(*) AS orphan_price_rows FROM raw_events WHERE id NOT IN (SELECT id FROM raw_entities)"),
    "orphan_entities": raw("SELECT count(*) AS orphan_properties FROM raw_entities WHERE id NOT IN (SELECT id FROM raw_events)"),
    "event_cardinality": raw("""SELECT sum(n)::BIGINT AS total_rows, count(*) AS total_properties, (sum(n) // count(*))::BIGINT AS avg_prices_per_property
FROM (SELECT id, count(*) AS n FROM raw_events GROUP BY id)"""),
    "duplicate_event_keys": raw("""SELECT * FROM (SELECT id AS property_id, day_text AS sale_date, count(*) AS count FROM raw_events GROUP BY ALL)
WHERE count > 1"""),
    "clean_events": clean("SELECT id AS property_id, day AS sale_date, price AS sale_price, flag AS new_build_at_sale FROM events"),
    "clean_event_count": raw("SELECT count(DISTINCT (id, day_text)) AS rows FROM raw_events WHERE day_text IS NOT NULL"),
    "grain_violations": clean("SELECT count(*) - count(DISTINCT (id, day)) AS violations FROM events"),
    "clean_entities": clean(f"""SELECT id AS property_id, address, code AS postcode, string_split(code, ' ')[1] AS postcode_area,
  kind AS property_type, subkind AS property_subtype, beds AS bedrooms, baths AS bathrooms, tenure, price_text AS latest_price_raw,
  {MONEY.format('price_text')} AS latest_sale_price, day_text::DATE AS latest_sale_date, flag AS new_build FROM entities"""),
    "clean_vs_raw_parity": clean("""SELECT unnest(['properties_main_clean', 'properties_main']) AS table_name, count(*) AS rows FROM entities"""),
    "clean_null_checks": clean(f"""SELECT count(*) - count(code) AS null_postcode, count(*) - count({MONEY.format('price_text')}) AS null_latest_sale_price,
  count(*) - count(day_text::DATE) AS missing_latest_sale_date FROM entities"""),
    "postcode_coverage": raw(f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE regexp_matches(upper(address), '{POSTCODE_PATTERN}'))
  AS postcode_found FROM raw_entities"""),
    "enrich_sales": q("""SELECT id AS property_id, day AS sale_date, price AS sale_price, flag AS new_build_at_sale, address, code AS postcode,
  district AS postcode_district, kind AS property_type, subkind AS property_subtype, beds AS bedrooms, baths AS bathrooms, tenure,
  entity_flag AS property_new_build_flag, area AS postcode_area, area_name AS postcode_area_name, region, country FROM sales"""),
    "match_report": q(f"""SELECT district AS postcode_district, count(*) AS sales_count, count(*) - count(area) AS unmatched_count,
  {rnd(ratio('100 * (count(*) - count(area))', 'count(*)'), 2)} AS pct_unmatched FROM sales GROUP BY district"""),
    "resale_change_by_type": change({"kind": "property_type"}),
    "resale_change_by_type_area": change({"kind": "property_type", "area": "postcode_area", "area_name": "postcode_area_name", "region": "region"}),
    "time_to_next_sale": q(f"""SELECT kind AS property_type, {AREA}, {rnd(mid('wait'), 1)} AS median_years_to_next_sale, count(*) AS resale_pairs_count
FROM (SELECT *, (lead(day) OVER (PARTITION BY id ORDER BY day) - day) / 365.25::DOUBLE AS wait FROM sales) WHERE wait IS NOT NULL GROUP BY ALL"""),
    "quick_resale_flags": q(f"""SELECT DISTINCT id AS property_id, any_short::INT AS has_quick_{SHORT}y, any_long::INT AS has_quick_{LONG}y
FROM resales WHERE any_ok""", GAPS),
    "quick_resale_shares": q(f"SELECT {GROUP}, {TOTALS} FROM counts", GAPS, COUNTS),
    "quick_resale_gains": q(f"SELECT {GROUP}, {gains(3)} FROM counts WHERE has_event", GAPS, COUNTS),
    "quick_resale_summary": q(f"SELECT {GROUP}, {TOTALS}, {gains(1)} FROM counts", GAPS, COUNTS),
    "period_growth_wide": q(f"""SELECT postcode_area, postcode_area_name, region, country, {rnd('a', 3)} AS median_price_{YA}, {rnd('b', 3)} AS median_price_{YB},
  sales_count_{YA}, sales_count_{YB}, percent_change FROM growth""", GROWTH),
    "period_growth_long": LONG_GROWTH,
    "export_long_result": LONG_GROWTH,
    "premium_new_vs_old": premium(f"area_name = '{P.premium_area}'"),
    "premium_new_vs_old_all": premium("true"),
    "median_by_tenure": q(f"""SELECT {AREA}, {rnd(mid('price'), 3)} AS median_sale_price,
  if(any_value(tenure) IN ('Freehold', 'Leasehold'), any_value(tenure), 'Unknown') AS tenure_category, count(*) AS sales_count
FROM sales WHERE price IS NOT NULL AND area IS NOT NULL GROUP BY area, area_name, tenure"""),
    "holding_metrics": q("SELECT * EXCLUDE review_flag FROM metrics", *PRICED),
    "holding_review_flag": q("SELECT * FROM metrics", *PRICED),
    "winners_losers_dense": q(f"""SELECT m.*, if(high <= {P.top_n}, 'Winner', 'Loser') AS bucket, if(high <= {P.top_n}, high, low) AS rank_in_bucket
FROM metrics m JOIN places ON v = pct_change AND least(high, low) <= {P.top_n} WHERE first_price >= {P.floor}""", *PRICED, ends("pct_change")),
    "holding_metrics_guarded": q("SELECT * FROM guarded", *GUARDED),
    "winners_losers_annualized": q(" UNION ALL ".join(f"""SELECT *, '{label}' AS category FROM guarded
WHERE first_recorded_price >= {P.floor} AND (annualized_return <= {P.cap} OR days_held < {P.min_hold_days}) AND annualized_return IS NOT NULL
QUALIFY row_number() OVER (ORDER BY annualized_return {way}, property_id) <= {P.top_n}
""" for label, way in (("Winner", "DESC"), ("Loser", "ASC"))), *GUARDED),
    "filter_retention": q(f"""SELECT *, {rnd(ratio('100 * after_90_day_rule', 'total_eligible'), 2)} AS pct_remaining_after_90_day_rule,
  {rnd(ratio('100 * after_90_day_and_25_cap', 'after_90_day_rule'), 2)} AS pct_remaining_after_25_cap_of_90plus,
  {rnd(ratio('100 * after_90_day_and_25_cap', 'total_eligible'), 2)} AS pct_remaining_after_both_filters
FROM (SELECT count(*) FILTER (WHERE {ELIGIBLE}) AS total_eligible, count(*) FILTER (WHERE {HELD}) AS after_90_day_rule,
        count(*) FILTER (WHERE {CAPPED}) AS after_90_day_and_25_cap FROM guarded)""", *GUARDED),
    "busiest_areas": q("SELECT * FROM busy", SHOCK),
    "shock_year_medians": q(f"""SELECT n.area AS postcode_area, n.area_name AS postcode_area_name, n.yr AS sale_year, {rnd('n.m', 3)} AS median_price,
  n.n AS sales_count, n.s AS shock_year, ['Before', 'Shock', 'After'][n.yr - n.s + 2] AS year_role, {rnd('b.m', 3)} AS median_price_before,
  {rnd('a.m', 3)} AS median_price_after, {rnd(ratio('100 * (a.m - b.m)', 'b.m'), 1)} AS pct_change_before_to_after
FROM near n JOIN busy ON postcode_area = n.area LEFT JOIN near b ON b.area = n.area AND b.s = n.s AND b.yr = n.s - 1
LEFT JOIN near a ON a.area = n.area AND a.s = n.s AND a.yr = n.s + 1""", SHOCK),
}
