"""Versions of stored frames, their layout, and several items over one of them."""

import os

import pytest
from pyspark.sql import functions as F

from resalekit.operators import ranking
from resalekit.plans import questions, store
from resalekit.plans.params import Params
from resalekit.plans.questions import PIPELINES, Inputs, build_tables, frames_of, run, run_many, shared_frames
from resalekit.sources.bindings import RawTables

SF = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no driver data")


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    if not os.path.exists(f"{SF}/orders.parquet"):
        pytest.skip("no driver data")
    return build_tables(Inputs(spark, SF), str(tmp_path_factory.mktemp("store")), (*questions.STORED, "guarded"), buckets=4)


def test_windows_and_joins_by_entity_need_no_exchange_and_no_sort(stored):
    from pyspark.sql import Window
    by_date = Window.partitionBy("property_id").orderBy("sale_date")
    lag = stored.enriched.select("property_id", F.lag("sale_price").over(by_date).alias("a"), F.lead("sale_date").over(by_date).alias("b"))
    plan = plan_of(lag)
    assert "Window" in plan and "Exchange" not in plan and "Sort [" not in plan
    ends = stored.enriched.groupBy("property_id").agg(F.min_by("sale_price", "sale_date"), F.max("sale_date"))
    assert "Exchange" not in plan_of(ends)
    pair = stored.clean_events.hint("merge").join(stored.clean_entities, "property_id")
    assert "SortMergeJoin" in plan_of(pair) and "Exchange" not in plan_of(pair)


@pytest.mark.parametrize("name", ["quick_resale_flags", "holding_metrics", "resale_change_by_type", "winners_losers_annualized"])
def test_items_over_stored_tables(spark, stored, name):
    assert rows_of(run(name, spark, SF, tables=stored.tables)) == rows_of(run(name, spark, SF))
    if name in ("quick_resale_flags", "holding_metrics"):
        assert "hashpartitioning" not in plan_of(PIPELINES[name](stored))


def test_another_session_reads_the_same_tables(stored):
    other = stored.spark.newSession()
    for n in questions.STORED:
        stored.spark.sql(f"DROP TABLE {store._table_name(stored.version, n)}")
    again = Inputs(other, SF, tables=stored.tables)
    assert again.enriched.count() == again.clean_events.count() > 0
    assert "Bucketed: true" in again.enriched.select("property_id").groupBy("property_id").count()._jdf.queryExecution().explainString(
        stored.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_parameters_of_a_stored_frame(spark, stored):
    assert "Exchange" not in plan_of(stored.guarded) and "min_by" not in plan_of(stored.guarded).lower()
    other = Inputs(spark, SF, params=Params(min_hold_days=400), tables=stored.tables)
    assert rows_of(other.guarded) == rows_of(Inputs(spark, SF, params=Params(min_hold_days=400)).guarded)


def test_a_failed_build_leaves_the_version_before(spark, tmp_path, raw_events, raw_entities, geo):
    events = raw_events.where("deedDate is not null and displayPrice <> 'POA'")
    entities = raw_entities.where("property_id <> 4")
    place = str(tmp_path / "t")
    with pytest.raises(ValueError):
        Inputs(spark, tables=place, raw_tables=RawTables(events, entities, geo)).enriched  # noqa: B018
    first = build_tables(Inputs(spark, raw_tables=RawTables(events, entities, geo)), place, buckets=2)
    reader, n = Inputs(spark, raw_tables=first.raw_tables, tables=place), first.enriched.count()
    with pytest.raises(ValueError):
        build_tables(Inputs(spark, raw_tables=RawTables(events, entities, geo.unionByName(geo))), place, buckets=2)
    assert store.current(spark, place) == first.version and reader.enriched.count() == n
    more = events.unionByName(events.limit(1).withColumn("deedDate", F.lit("2024-01-01")))
    second = build_tables(Inputs(spark, raw_tables=RawTables(more, entities, geo)), place, buckets=2)
    assert second.version.number == 2 and second.enriched.count() == n + 1
    assert reader.enriched.count() == n  # goes on with the version it began with
    assert store.expire(spark, place) == []  # all too young
    gone = store.expire(spark, place, keep=1, older_than=0)
    assert len(gone) == 2 and os.listdir(f"{place}/versions") == [second.version.folder.rsplit("/", 1)[1]]
    assert build_tables(Inputs(spark, raw_tables=RawTables(more, entities, geo)), place, buckets=2).version.number == 3


def test_shared_frames():
    assert frames_of("resale_change_by_type") == {"enriched"} and frames_of("orphan_events") == set()
    assert frames_of("period_growth_long") == {"enriched"} and frames_of("winners_losers_dense") == {"holding"}
    assert shared_frames(["resale_change_by_type"]) == [] and shared_frames(["orphan_events", "clean_events"]) == []
    assert shared_frames(["resale_change_by_type", "median_by_tenure"]) == ["enriched"]
    assert shared_frames(["holding_metrics", "winners_losers_dense"]) == ["holding"]
    assert shared_frames(["holding_metrics", "winners_losers_annualized"]) == ["enriched"]
    assert shared_frames(["clean_events", "enrich_sales"]) == ["clean_events"]
    assert shared_frames(["clean_event_count", "grain_violations"]) == ["clean_events"]


@have_data
def test_many_items_compute_their_frames_once(spark, tmp_path, monkeypatch):
    names = list(PIPELINES)[list(PIPELINES).index("resale_change_by_type"):-1]
    plans = []
    make = store.build

    def noted(spark_, location, frames, **kw):
        def wrapped(f):
            def run_(held):
                df = f(held)
                plans.append(plan_of(df))
                return df
            return run_
        return make(spark_, location, {n: wrapped(f) for n, f in frames.items()}, **kw)

    monkeypatch.setattr(store, "build", noted)
    got = run_many(names, spark, SF, str(tmp_path / "many"), buckets=4)
    raw = "testdata/sf0.001/orders.parquet"
    assert sum(p.count(raw) for p in plans) == 1 and not any(raw in plan_of(df) for df in got.values())
    assert len(got) == len(names) == 20
    for name in ("quick_resale_summary", "winners_losers_dense", "shock_year_medians", "filter_retention"):
        assert rows_of(got[name]) == rows_of(run(name, spark, SF)), name


@have_data
@pytest.mark.parametrize("source", ["raw", "stored"])
def test_sql_over_the_view_equals_the_item(spark, stored, source):
    inputs = stored if source == "stored" else Inputs(spark, SF)
    view = inputs.create_view(f"sales_{source}")
    got = spark.sql(f"""
        SELECT postcode_area, postcode_area_name, round(percentile(cast(sale_price AS double), 0.5), 3) AS median_sale_price,
               if(tenure IN ('Freehold', 'Leasehold'), tenure, 'Unknown') AS tenure_category, count(*) AS sales_count
        FROM {view} WHERE sale_price IS NOT NULL AND postcode_area IS NOT NULL GROUP BY postcode_area, postcode_area_name, tenure""")
    want = run("median_by_tenure", spark, SF)
    key = lambda r: tuple(str(r[c]) for c in ("postcode_area", "postcode_area_name", "tenure_category", "sales_count"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert sorted(str(r.median_sale_price) for r in got.collect()) == sorted(str(r.median_sale_price) for r in want.collect())


def test_both_ends_are_limited_before_the_shuffle(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("property_id"), (F.col("id") % 37).cast("double").alias("m"))
    plan = plan_of(ranking.two_sided_limit(df, "m", 3))
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "hashpartitioning(__rank_end" in line and "__rank_salt" in line)
    assert "WindowGroupLimit" in lines[at + 1] and plan.count("Range (") == 1
    # a value that most rows share
    hot = spark.range(0, 4000).selectExpr("id AS property_id", "if(id < 3900, 7.0D, cast(id AS double)) AS m")
    got = ranking.two_sided_dense(hot, "m", 2).groupBy("bucket", "rank_in_bucket").count().collect()
    assert sorted(map(tuple, got)) == [("Loser", 1, 3900), ("Loser", 2, 1), ("Winner", 1, 1), ("Winner", 2, 1)]
    few = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 4.0), (4, None)], "property_id long, m double")
    assert sorted((r.property_id, r.bucket, r.rank_in_bucket) for r in ranking.two_sided_dense(few, "m", 9).collect()) == [
        (1, "Winner", 1), (2, "Winner", 1), (3, "Winner", 2)]
