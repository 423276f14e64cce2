"""Driver contract, plan shape and oracle parity on the smallest driver data."""

import os
import re

import pytest

import __spark_entry__ as entry
from resalekit.plans.oracle import ORACLE
from resalekit.plans.questions import PIPELINES, Inputs, build_tables, run
from resalekit.sources.bindings import bind_raw

SF = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no driver data")


def test_registry_keys():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(PIPELINES) <= set(q) and set(ORACLE) == set(PIPELINES) and len(PIPELINES) == 38


@have_data
def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["property_type", "median_percent_price_change", "resale_events_used"]
    assert len(rows) > 0


@have_data
def test_plans_have_no_python_udfs(spark):
    for name in ["resale_change_by_type", "quick_resale_summary", "holding_metrics",
                 "period_growth_long", "shock_year_medians"]:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


@have_data
def test_date_range_and_columns_reach_the_stored_table(spark, tmp_path):
    stored = build_tables(Inputs(spark, SF), str(tmp_path))
    from resalekit.operators.segments import busiest_areas
    plan = busiest_areas(stored.enriched, (1996, 1999))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(sale_date" in scan and "address" not in scan.split("ReadSchema")[1]
    a = sorted(map(tuple, run("median_by_tenure", spark, SF).collect()), key=str)
    assert a == sorted(map(tuple, run("median_by_tenure", spark, SF, tables=str(tmp_path)).collect()), key=str)


@have_data
def test_raw_checks_read_narrow_columns(spark):
    plan = run("orphan_events", spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_acctbal" not in plan


@have_data
def test_a_replaced_source_gives_a_new_result(spark, tmp_path):
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    seen = []
    for df in (orders, orders.unionByName(orders)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        rows = {r.table_name: r.rows for r in run("profile_row_counts", spark, str(tmp_path)).collect()}
        seen.append(rows["price_history"])
    assert seen[1] == 2 * seen[0]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_pipelines_over_raw_tables(spark, tmp_path, raw_events, raw_entities, geo, fmt):
    from resalekit.sources.sinks import write_result
    entities = raw_entities.where("property_id <> 4")  # its price text is not a number
    events = raw_events.where("deedDate is not null")
    for name, df in (("events", events), ("entities", entities), ("geo", geo)):
        write_result(df, f"{tmp_path}/{name}", fmt)
    raw = bind_raw(spark, f"{tmp_path}/events", f"{tmp_path}/entities", f"{tmp_path}/geo", fmt)
    assert run("orphan_events", spark, raw_tables=raw).first()[0] == 4
    assert run("clean_event_count", spark, raw_tables=raw).first()[0] == 16
    flat = {r.property_type: r for r in run("resale_change_by_type", spark, raw_tables=raw).collect()}["Flat"]
    assert flat.median_percent_price_change == 15.3


def test_csv_with_another_header_fails(spark, tmp_path, raw_events):
    raw_events.select("deedDate", "property_id", "displayPrice", "newBuild").write.option("header", "true").csv(str(tmp_path / "e"))
    from resalekit.sources.readers import read_raw_events
    with pytest.raises(Exception):
        read_raw_events(spark, str(tmp_path / "e"), "csv").collect()


def test_duplicate_district_fails_before_the_join(spark, tmp_path, raw_events, raw_entities, geo):
    from resalekit.sources.bindings import RawTables
    raw = RawTables(raw_events.where("deedDate is not null"), raw_entities, geo.unionByName(geo))
    with pytest.raises(ValueError):
        build_tables(Inputs(spark, raw_tables=raw), str(tmp_path))


def test_sink_formats(spark, tmp_path):
    from resalekit.sources import sinks
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    sinks.write_result(df, str(tmp_path / "csv"), "csv", single_file=True)
    assert len([f for f in os.listdir(tmp_path / "csv") if f.startswith("part-")]) == 1
    sinks.write_result(df, str(tmp_path / "p"), partition_by=["part"])
    assert sorted(d for d in os.listdir(tmp_path / "p") if "=" in d) == ["part=0", "part=1"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 10


ORACLE_SUBSET = ["clean_events", "enrich_sales", "match_report", "resale_change_by_type", "time_to_next_sale",
                 "quick_resale_summary", "period_growth_long", "premium_new_vs_old",
                 "median_by_tenure", "winners_losers_dense", "winners_losers_annualized",
                 "filter_retention", "shock_year_medians", "duplicate_event_keys", "orphan_events",
                 "clean_null_checks", "export_long_result", "premium_new_vs_old_all"]


def _canon(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 9)
    return v


@have_data
@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_parity_sf0001(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["orders", "customer", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(sdf.columns)
    srows = sorted((tuple(_canon(r[c]) for c in order) for r in sdf.collect()), key=repr)
    didx = [dcols.index(c) for c in order]
    drows = sorted((tuple(_canon(r[i]) for i in didx) for r in cur.fetchall()), key=repr)
    assert srows == drows


@have_data
def test_lineitem_binding_runs(spark):
    from resalekit.plans.questions import run
    rows = run("holding_metrics", spark, SF, "lineitem").collect()
    assert len(rows) > 0
    r = run("filter_retention", spark, SF, "lineitem").collect()[0]
    assert r.total_eligible >= r.after_90_day_rule >= r.after_90_day_and_25_cap
