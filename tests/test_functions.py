import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalekit.functions.median import group_median, group_medians, order_bucket
from resalekit.functions.numeric import (days_between, parse_date, parse_money, pct_change,
                                         round_half_up, safe_div, years_between)
from resalekit.functions.text import (extract_postcode, label_or_unknown, map_labels,
                                      normalise_key, outward_code)


def one(df):
    return df.collect()[0]


def test_round_half_up_is_decimal_half_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (-1.005,), (2.5,), (float("inf"),), (None,)], "x double")
    out = [r[0] for r in df.select(round_half_up("x", 2)).collect()]
    assert out[0] == 1.01 and out[1] == -1.01 and out[2] == 2.5
    assert math.isinf(out[3]) and out[4] is None


def test_integer_division_truncates(spark):
    from resalekit.operators.checks import cardinality
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,)], "property_id long")
    r = one(cardinality(df))
    assert (r.total_rows, r.total_properties, r.avg_prices_per_property) == (5, 2, 2)


def test_date_difference_is_whole_days(spark):
    df = spark.createDataFrame([("2010-01-01", "2010-12-31")], "a string, b string")
    r = one(df.select(days_between(F.col("b").cast("date"), F.col("a").cast("date")).alias("d"),
                      years_between(F.col("b").cast("date"), F.col("a").cast("date")).alias("y")))
    assert r.d == 364 and abs(r.y - 364 / 365.25) < 1e-12


def test_parse_money_keeps_digits_and_dots(spark):
    df = spark.createDataFrame([("£1,250,000",), ("-5",), ("POA",), (None,)], "s string")
    out = [r[0] for r in df.select(parse_money("s")).collect()]
    assert [None if v is None else float(v) for v in out] == [1250000.0, 5.0, None, None]


def test_parse_money_strict_raises_and_lenient_nulls(spark):
    df = spark.createDataFrame([("£1.2.3",)], "s string")
    with pytest.raises(Exception):
        df.select(parse_money("s")).collect()
    assert one(df.select(parse_money("s", on_error="null")))[0] is None


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("Jan 3, 1995",), ("1995-01-03",)], "s string")
    out = [r[0] for r in df.select(parse_date("s", ["MMM d, yyyy", "yyyy-MM-dd"])).collect()]
    assert [str(d) for d in out] == ["1995-01-03", "1995-01-03"]
    with pytest.raises(Exception):
        df.select(parse_date("s")).collect()


@pytest.mark.parametrize("formats", [None, ["yyyy-MM-dd"]])
def test_parse_date_strict_raises_with_and_without_formats(spark, formats):
    df = spark.createDataFrame([("03/01/1995",), (None,)], "s string")
    with pytest.raises(Exception, match="not a date"):
        df.select(parse_date("s", formats)).collect()
    assert [r[0] for r in df.select(parse_date("s", formats, "null")).collect()] == [None, None]


def test_strict_parsing_does_not_depend_on_ansi(spark):
    df = spark.createDataFrame([("1.2.3", "x")], "m string, d string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for c in (parse_money("m"), parse_date("d")):
            with pytest.raises(Exception):
                df.select(c).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_postcode_extraction_and_district(spark):
    df = spark.createDataFrame([("1 High St, London sw7 1rh",), ("x SW71RH",), ("no postcode",)], "a string")
    rows = df.select(extract_postcode("a").alias("p")).select("p", outward_code("p").alias("d")).collect()
    assert [(r.p, r.d) for r in rows] == [("SW7 1RH", "SW7"), ("SW71RH", "SW71RH"), (None, None)]


def test_labels_and_keys(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" m1 ",), ("Feudal",)], "s string")
    rows = df.select(label_or_unknown("s").alias("a"), label_or_unknown("s", True).alias("b"),
                     normalise_key("s").alias("k"),
                     map_labels("s", {"Freehold": "Freehold"}).alias("m")).collect()
    assert [r.a for r in rows] == ["Unknown", "  ", " m1 ", "Feudal"]
    assert [r.b for r in rows] == ["Unknown", "Unknown", "m1", "Feudal"]
    assert rows[2].k == "M1" and {r.m for r in rows} == {"Unknown"}


def test_ratio_helpers_guard_zero(spark):
    df = spark.createDataFrame([(10.0, 0.0), (15.0, 10.0)], "a double, b double")
    rows = df.select(safe_div("a", "b").alias("r"), pct_change("a", "b").alias("p")).collect()
    assert rows[0].r is None and rows[0].p is None and rows[1].p == 50.0


def test_order_bucket_is_monotone(spark):
    vals = [-1e12, -1000.5, -1.0, -0.5, -1e-9, 0.0, 1e-9, 0.25, 1.0, 3.0, 1e6, 1e300,
            float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ks = [r[0] for r in df.select(order_bucket(F.col("v"))).collect()]
    assert ks == sorted(ks)


def _random_groups(n_groups=7, seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        size = rnd.choice([1, 2, 3, 10, 101, 500])
        for _ in range(size):
            v = rnd.choice([rnd.uniform(-50, 50), round(rnd.uniform(0, 5), 1), 1e5 * rnd.random(), None])
            rows.append((None if g == 0 else f"g{g}", v))
    rows.append(("all_null", None))
    return rows


def test_group_median_matches_spark_percentile(spark):
    df = spark.createDataFrame(_random_groups(), "g string, v double")
    dist = {r.g: (r.m, r.c) for r in group_median(df, ["g"], "v", "m", count_alias="c").collect()}
    ref = {r.g: (r.m, r.c) for r in group_median(df, ["g"], "v", "m", count_alias="c",
                                                 method="builtin").collect()}
    assert dist.keys() == ref.keys()
    for k in ref:
        assert dist[k][1] == ref[k][1]
        if ref[k][0] is None:
            assert dist[k][0] is None
        else:
            assert abs(dist[k][0] - ref[k][0]) <= 1e-9 * max(1.0, abs(ref[k][0]))
    assert dist["all_null"] == (None, 1)
    assert None in dist  # NULL group key kept


def test_group_median_one_hot_group_with_ties(spark):
    rows = [("hot", float(i % 97)) for i in range(20000)] + [("small", 1.0), ("small", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r.m for r in group_median(df, ["g"], "v", "m").collect()}
    vals = sorted(v for g, v in rows if g == "hot")
    n = len(vals)
    expect = vals[(n - 1) // 2] + (vals[n // 2] - vals[(n - 1) // 2]) * 0.5
    assert out["hot"] == expect and out["small"] == 2.5


def test_group_medians_of_overlapping_subsets(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0), ("x", 10.0), ("y", 4.0), (None, None)], "g string, v double")
    out = {r.g: r for r in group_medians(df, ["g"], "v", {"le3": F.col("v") <= 3, "all": None}).collect()}
    assert (out["x"].le3, out["x"].le3_count, out["x"].all, out["x"].all_count) == (2.0, 3, 2.5, 4)
    assert (out["y"].le3, out["y"].le3_count, out["y"].all) == (None, 0, 4.0)
    assert (out[None].all, out[None].all_count) == (None, 1)


@pytest.mark.parametrize("finer", [True, False])
def test_group_median_with_all_values_in_one_band(spark, finer):
    """A third of the rows in one group, all its values in one bucket."""
    vals = [1_700_000_000.0 + (i * 7919) % 5000 for i in range(6001)]
    df = spark.createDataFrame([("hot", v) for v in vals] + [(f"g{i}", float(i)) for i in range(9000)], "g string, v double")
    out = {r.g: r.m for r in group_median(df, ["g"], "v", "m", finer=finer).collect()}
    assert out["hot"] == sorted(vals)[3000] and out["g77"] == 77.0 and len(out) == 9001


def test_group_median_reads_its_source_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(5000).selectExpr("id % 3 AS g", "cast(id AS double) * 1.37 AS v", "id AS unused").write.parquet(path)
    out = group_median(spark.read.parquet(path), ["g"], "v", "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Scan parquet") <= 1  # the first pass has run
    assert "unused" not in plan


def test_group_median_empty_by(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], T.StructType([T.StructField("v", T.DoubleType())]))
    r = one(group_median(df, [], "v", "m", count_alias="c"))
    assert (r.m, r.c) == (3.0, 3)


def _plans(monkeypatch):
    """The physical plans of what the medians stage, as they run."""
    from resalekit.functions import median
    seen = []

    def noted(df, name, stage=median.stage):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(median, "stage", noted)
    return seen


def _reads(plan, path):
    return sum(path in line for line in plan.split("== Initial Plan ==")[0].splitlines() if "FileScan" in line)


def test_medians_of_many_groups_take_two_narrow_scans(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    spark.range(220_000).selectExpr("id % 50000 AS g", "cast(hash(id) % 10007 AS double) / 4 AS v", "id AS unused").withColumn(
        "g", F.expr("if(v < 200, -1, g)")).write.parquet(path)
    seen = _plans(monkeypatch)
    df = spark.read.parquet(path)
    got = {r.g: r.m for r in group_median(df, ["g"], "v", "m").collect()}
    assert sum(_reads(plan, path) for _, plan in seen) == 2 and not any("unused" in plan for _, plan in seen)
    assert got == {r.g: r.m for r in group_median(df, ["g"], "v", "m", method="builtin").collect()} and len(got) > 45_000


def test_a_computed_source_of_medians_runs_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    spark.range(9000).selectExpr("id % 7 AS g", "cast(id * 37 % 4001 AS double) AS v", "id % 3 AS k").write.parquet(path)
    seen = _plans(monkeypatch)
    df = spark.read.parquet(path).dropDuplicates(["g", "v"]).join(spark.range(3).withColumnRenamed("id", "k"), "k")
    got = {r.g: r.m for r in group_median(df, ["g"], "v", "m").collect()}
    assert sum(_reads(plan, path) for _, plan in seen) == 1
    assert got.keys() == set(range(7))


@pytest.mark.parametrize("margin", [-0.2, 0.0, 0.02])
def test_a_bracket_that_misses_its_rank_is_found_out(spark, margin):
    df = spark.range(30_000).selectExpr("id % 2 AS g", "cast(hash(id) % 5003 AS double) AS v", "id % 3 = 0 AS some")
    by = {"all": None, "third": F.col("some")}
    got = {r.g: (r.all, r.third) for r in group_medians(df, ["g"], "v", by, sketch=64, margin=margin).collect()}
    rows = df.collect()
    for g in (0, 1):
        for at, own in enumerate(([r.v for r in rows if r.g == g], [r.v for r in rows if r.g == g and r.some])):
            own.sort()
            assert got[g][at] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2


@pytest.mark.parametrize("size", [1, 2, 999, 1024, 1025, 3001])
def test_medians_with_nan_infinity_and_ties(spark, size):
    rnd = random.Random(size)
    kinds = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, None]
    rows = [(g, rnd.choice(kinds) if rnd.random() < share else rnd.uniform(-9, 9)) for g, share in (("few", 0.1), ("many", 0.9)) for _ in range(size)]
    rows += [("nan", float("nan"))] * size + [("inf", float("inf"))] * size
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in group_median(df, ["g"], "v", "m").collect()}
    for g in ("few", "many", "nan", "inf"):
        own = sorted((v for h, v in rows if h == g and v is not None), key=lambda v: (v != v, v if v == v else 0.0))
        if not own:
            assert got[g] is None
            continue
        lo, hi = own[(len(own) - 1) // 2], own[len(own) // 2]
        want = lo if lo == hi else lo + (hi - lo) * 0.5
        assert got[g] == want or (got[g] != got[g] and want != want)
