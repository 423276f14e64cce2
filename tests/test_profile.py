"""Checks that come with the write of the clean tables, and counts from Parquet footers."""

import os

import pytest
from pyspark.sql import functions as F

from resalekit.plans import questions, store
from resalekit.plans.profile import Profile
from resalekit.plans.questions import PIPELINES, Inputs, build_tables, run, run_many
from resalekit.sources.bindings import RawTables, bind_raw

SF = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no driver data")
ITEMS = ["profile_row_counts", "profile_date_range", "profile_missing_dates", "clean_event_count", "clean_vs_raw_parity",
         "clean_null_checks", "postcode_coverage"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def formatted(df):
    mode = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@have_data
def test_profile_of_the_write_equals_the_single_items(spark, tmp_path, monkeypatch):
    plans, make = [], store.build

    def noted(spark_, location, frames, **kw):
        def wrapped(f):
            def run_(held):
                df = f(held)
                plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
                return df
            return run_
        return make(spark_, location, {n: wrapped(f) for n, f in frames.items()}, **kw)

    monkeypatch.setattr(store, "build", noted)
    stored = build_tables(Inputs(spark, SF), str(tmp_path / "p"), buckets=2, profiled=True)
    assert stored.version.profile is not None
    for raw in ("orders", "customer"):  # one scan of each raw table for cleaning and all of the checks
        assert sum(p.count(f"{SF[1:]}/{raw}.parquet") for p in plans) == 1
    for name in ITEMS:
        got, want = run(name, spark, SF, tables=stored.tables), run(name, spark, SF)
        assert "Scan" not in formatted(got).replace("LocalTableScan", "").replace("Scan ExistingRDD", ""), name
        assert rows_of(got) == rows_of(want) and got.dtypes == want.dtypes, name
    assert rows_of(run("profile_events_per_year", spark, SF, tables=stored.tables)) == rows_of(run("profile_events_per_year", spark, SF))


def test_edge_rows_and_empty_tables(spark, tmp_path, raw_events, raw_entities, geo):
    entities = raw_entities.withColumn("latest_price", F.when(F.col("property_id") != 4, F.col("latest_price")))
    for i, (events, entities) in enumerate([(raw_events, entities), (raw_events.limit(0), entities.limit(0))]):
        raw = RawTables(events, entities, geo)
        stored = build_tables(Inputs(spark, raw_tables=raw), str(tmp_path / str(i)), buckets=2, profiled=True)
        for name in ITEMS:
            assert rows_of(run(name, spark, tables=stored.tables, raw_tables=raw)) == rows_of(run(name, spark, raw_tables=raw)), name
    with pytest.raises(ValueError):
        build_tables(Inputs(spark, raw_tables=raw), str(tmp_path / "x"), ("clean_events",), profiled=True)


@have_data
def test_a_profile_that_does_not_agree_is_not_kept(spark, tmp_path, monkeypatch):
    real = questions.numbers
    monkeypatch.setattr(questions, "numbers", lambda seen: real(seen) | {"events": real(seen)["events"] | {"rows": 1}})
    stored = build_tables(Inputs(spark, SF), str(tmp_path / "p"), buckets=2, profiled=True)
    assert stored.version.profile is None
    assert rows_of(run("profile_row_counts", spark, SF, tables=stored.tables)) == rows_of(run("profile_row_counts", spark, SF))
    told = {"events": {"rows": 3}}
    assert Profile(told).agrees({}) and Profile(told).agrees({"events": 3}) and not Profile(told).agrees({"events": 4})


@have_data
def test_counts_come_from_footers(spark, tmp_path, raw_events, raw_entities, geo):
    stored = build_tables(Inputs(spark, SF), str(tmp_path / "stored"), buckets=2)
    for name, n in (("profile_row_counts", 2), ("clean_vs_raw_parity", 2), ("clean_event_count", 1)):
        df = PIPELINES[name](stored)
        assert formatted(df).count("PushedAggregation: [COUNT(*)]") == n, name
        assert formatted(df).count("ReadSchema: struct<count(*):bigint>") == n, name
        assert rows_of(df) == rows_of(run(name, spark, SF))
    assert formatted(run("profile_row_counts", spark, SF)).count("PushedAggregation: [COUNT(*)]") == 2
    # the reader is chosen for these frames alone
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    for name, df in (("e", raw_events), ("p", raw_entities), ("g", geo)):
        df.write.parquet(str(tmp_path / name))
        if name != "g":
            df.write.csv(str(tmp_path / f"{name}-csv"), header=True)
    bound = bind_raw(spark, *(str(tmp_path / n) for n in "epg"))
    counted = run("profile_row_counts", spark, raw_tables=bound)
    assert "PushedAggregation" in formatted(counted)
    assert rows_of(counted) == [("price_history", raw_events.count()), ("properties_main", raw_entities.count())]
    raw_events.limit(0).write.parquet(str(tmp_path / "none"))
    none = run("profile_row_counts", spark, raw_tables=bind_raw(spark, str(tmp_path / "none"), str(tmp_path / "p"), str(tmp_path / "g")))
    assert rows_of(none)[0] == ("price_history", 0)


@have_data
def test_many_items_profile_on_the_way(spark, tmp_path):
    got = run_many(["clean_events", "clean_entities", "enrich_sales", "clean_null_checks", "profile_date_range"], spark, SF, str(tmp_path / "m"), buckets=2)
    assert "Scan parquet" not in formatted(got["profile_date_range"])
    assert rows_of(got["profile_date_range"]) == rows_of(run("profile_date_range", spark, SF))
