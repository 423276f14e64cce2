"""Exact grouped medians (PERCENTILE_CONT(0.5)) without a whole group in one task.

Spark's exact ``percentile`` merges a value -> count map of a group in one
task. ``group_medians`` selects by rank instead, in two scans of the group keys and the value:

1. a mergeable quantile sketch (KLL) of each group, with its counts. A group of up to
   ``SKETCH`` values is held whole, so its sketch gives the answer. Else the sketch gives a
   bracket of values around the middle ranks, ``MARGIN`` of the ranks wide on either side.
   These targets, one row per group, are staged;
2. rows up to the end of their group's bracket are counted, those inside it by value, and the
   middle ranks are looked up among these counts. The counts are exact, so a bracket that missed its
   rank shows, and its group is counted anew with a bracket without ends.

The values of a bracket with many rows are ranked in ``FINER`` parts of its range, so that a
task ranks those of one part. Several medians over overlapping subsets of the rows are conditional
counts in the same two scans. A source that is more than a scan with filters and columns
is staged first, its keys and value alone, so it is computed once.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resalekit.session import stage

BUCKETS_PER_OCTAVE = 1024
FINER = 4096
#: Values that a sketch holds at least; the share of ranks between a middle rank and its bracket's end, which
#: is over four times the sketch's error at 99 %.
SKETCH, MARGIN = 1024, 12 / 1024
#: Groups whose targets are broadcast at most; rows of a bracket that one task may rank.
SMALL_GROUPS, SMALL_BRACKET = 20_000, 1_000_000
_TOP = 2 ** 62


def _value(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def order_bucket(v: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Monotone non-decreasing bucket of a double: equal values share a
    bucket and a smaller value never gets a larger bucket. NULL -> NULL."""
    mag = F.floor(F.log2(F.abs(v) + F.lit(1.0)) * F.lit(float(per_octave)))
    return (F.when(F.isnan(v), F.lit(_TOP + 1))
            .when(v == F.lit(float("inf")), F.lit(_TOP))
            .when(v == F.lit(float("-inf")), F.lit(-_TOP))
            .when(v >= F.lit(0.0), mag)
            .when(v < F.lit(0.0), -mag - F.lit(1)))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the keys of ``left`` stay."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [left[k].eqNullSafe(other[f"_r{i}"]) for i, k in enumerate(keys)])
    return left.join(other, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def _plain(df: DataFrame) -> bool:
    """Whether ``df`` is a scan with filters and columns, which costs little to run again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not re.search(r"\b(Join|Aggregate|Window|Sort|Generate|Expand|Union|Limit|Sample|Repartition|MapIn|EvalPython)", plan)


def _targets(rows: DataFrame, by: list[str], n: int, size: int, margin: float) -> DataFrame:
    """One row per group. For subset i: _rows{i}, _known{i} (not NULL), and the values _x{i}0, _x{i}1 at
    the middle ranks where the sketch holds all, else the bracket _lo{i}, _hi{i}."""
    aggs = []
    for i in range(n):
        v = F.when(F.col(f"_in{i}"), F.col("_v"))
        # a sketch leaves NaN out, so there it is infinite: both come last
        aggs += [F.count_if(f"_in{i}").alias(f"_rows{i}"), F.count(v).alias(f"_known{i}"), F.count(F.when(F.isnan(v), v)).alias(f"_nan{i}"),
                 F.kll_sketch_agg_double(F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v), F.lit(size)).alias(f"_q{i}")]
    groups = rows.groupBy(*by).agg(*aggs)
    # of up to ``size`` values the two middle ones are next to one half on either side
    near = 0.25 / size
    asked = F.array(*[F.lit(0.5 + r) for r in (-near, near, -margin - 1 / size, margin + 1 / size)])
    out = list(by)
    for i in range(n):
        known = F.col(f"_known{i}")
        groups = groups.withColumn(f"_a{i}", F.when(known > 0, F.kll_sketch_get_quantile_double(f"_q{i}", asked)))
        out += [f"_rows{i}", f"_known{i}",
                *[F.when(F.expr(f"(_known{i} - {1 - t}) div 2 >= _known{i} - _nan{i}"), F.when(known > 0, F.lit(float("nan"))))
                  .when(known <= size, F.get(f"_a{i}", F.lit(t))).alias(f"_x{i}{t}") for t in (0, 1)],
                *[F.when(known > size, F.get(f"_a{i}", F.lit(at))).alias(name) for at, name in ((2, f"_lo{i}"), (3, f"_hi{i}"))]]
    return groups.select(*out)


def group_medians(df: DataFrame, by: Sequence[str], value, subsets: Mapping[str, Column | None], *,
                  finer: bool | None = None, sketch: int = SKETCH, margin: float = MARGIN) -> DataFrame:
    """Median of ``value`` per group of ``by`` for each subset (name -> condition,
    None for all rows): ``by`` + [name, name + '_count'] for each.

    One row per group of ``df``, as GROUP BY gives; the count is COUNT(*) of the
    subset's rows, NULL values included; the median ignores NULL values and is NULL
    without any other; NaN is the greatest value. Group keys may be NULL. ``finer`` forces ranking in parts
    on or off; by default it is used where a bracket has many rows. ``sketch`` and ``margin`` change the work, not the result.

    Both scans run when this is called; the result reads staged rows, one or two per group."""
    keys, n, names = list(by), len(subsets), list(subsets)
    rows = df.select(*[F.col(k) for k in keys], *([] if keys else [F.lit(0).alias("_all")]), _value(value).alias("_v"),
                     *[(F.lit(True) if c is None else F.coalesce(c, F.lit(False))).alias(f"_in{i}")
                       for i, c in enumerate(subsets.values())])
    by = keys or ["_all"]
    if not _plain(rows):
        rows = stage(rows, "median-rows")
    targets = stage(_targets(rows, by, n, sketch, margin), "median-targets")
    spots = [(i, t) for i in range(n) for t in (0, 1)]
    # a spot is open where a group has numbers at its rank and the sketch does not hold it
    open_ = {(i, t): F.col(f"_lo{i}").isNotNull() & F.col(f"_x{i}{t}").isNull() for i, t in spots}
    left = targets.where(reduce(lambda a, b: a | b, open_.values()))
    largest = F.greatest(F.lit(0), *[F.when(F.col(f"_lo{i}").isNotNull(), F.col(f"_known{i}")) for i in range(n)])
    few, most = left.agg(F.count(F.lit(1)), F.max(largest)).first()
    answer = {s: F.col("_x%d%d" % s) for s in spots}
    if few:
        parts = 2 * margin * most > SMALL_BRACKET if finer is None else finer
        targets = stage(_join(targets, _ranked(rows, left, by, n, spots, parts, few <= SMALL_GROUPS), by, "left"), "median-ranks")
        missed = targets.where(reduce(lambda a, b: a | b, [open_[s] & F.col("_y%d%d" % s).isNull() for s in spots]))
        if number := missed.count():
            again = missed.drop(*["_y%d%d" % s for s in spots])
            for i in range(n):
                for name, end in ((f"_lo{i}", "-inf"), (f"_hi{i}", "inf")):
                    again = again.withColumn(name, F.when(F.col(name).isNotNull(), F.lit(float(end))))
            anew = _ranked(rows, again, by, n, spots, True, number <= SMALL_GROUPS)
            anew = anew.select(*by, *[F.col("_y%d%d" % s).alias("_z%d%d" % s) for s in spots])
            targets = stage(_join(targets, anew, by, "left"), "median-ranks")
            answer = {s: F.coalesce(answer[s], F.col("_z%d%d" % s)) for s in spots}
        answer = {s: F.coalesce(answer[s], F.col("_y%d%d" % s)) for s in spots}
    out = []
    for i, name in enumerate(names):
        lo, hi = answer[i, 0], answer[i, 1]
        out += [F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.lit(0.5)).alias(name), F.col(f"_rows{i}").alias(f"{name}_count")]
    return targets.select(*keys, *out)


def _ranked(rows: DataFrame, targets: DataFrame, by: list[str], n: int, spots: list[tuple[int, int]], finer: bool, few: bool) -> DataFrame:
    """Per group of ``targets`` the values (_y) at the middle ranks of the subsets with a bracket; NULL where it missed."""
    ends = [f"{c}{i}" for i in range(n) for c in ("_lo", "_hi")]
    asked = targets.select(*by, *ends)
    hits = _join(rows.where(F.col("_v").isNotNull() & ~F.isnan("_v")), F.broadcast(asked) if few else asked, by)
    v = F.col("_v")
    reach = [F.coalesce(F.col(f"_in{i}") & (v <= F.col(f"_hi{i}")), F.lit(False)) for i in range(n)]
    some = lambda conditions: reduce(lambda a, b: a | b, conditions)
    inside = some([r & (v >= F.col(f"_lo{i}")) for i, r in enumerate(reach)])
    part = F.lit(0).cast("long")
    if finer:
        lo, hi = (f(F.array(*[F.col(f"{c}{i}") for i in range(n)])) for f, c in ((F.array_min, "_lo"), (F.array_max, "_hi")))
        wide = hi - lo
        even = F.floor(F.coalesce((v - lo) / F.nullif(wide, F.lit(0.0)), F.lit(0.0)) * F.lit(float(FINER)))
        part = F.when(F.abs(wide) < F.lit(float("inf")), even).otherwise(order_bucket(v)).cast("long")
    # all rows below the brackets of a group are one count, with no value
    counts = hits.where(some(reach)).select(*by, F.when(inside, part).alias("_p"), F.when(inside, v).alias("_v"),
                                            *[r.alias(f"_c{i}") for i, r in enumerate(reach)])
    counts = counts.groupBy(*by, "_p", "_v").agg(*[F.count_if(f"_c{i}").alias(f"_n{i}") for i in range(n)])
    up_to = lambda keys, order: Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    if finer:
        counts = stage(counts, "median-counts")
        sums = counts.groupBy(*by, "_p").agg(*[F.sum(f"_n{i}").alias(f"_m{i}") for i in range(n)])
        before = up_to(by, "_p")
        sums = sums.select(*by, "_p", *[(F.sum(f"_m{i}").over(before) - F.col(f"_m{i}")).alias(f"_f{i}") for i in range(n)])
        inner = up_to([*by, "_p"], "_v")
        ranked = counts.select("*", *[F.sum(f"_n{i}").over(inner).alias(f"_e{i}") for i in range(n)])
        ranked = _join(ranked, sums, [*by, "_p"])
        ranked = ranked.select(*by, "_v", *[f"_n{i}" for i in range(n)], *[(F.col(f"_e{i}") + F.col(f"_f{i}")).alias(f"_e{i}") for i in range(n)])
    else:
        inner = up_to(by, "_v")
        ranked = counts.select("*", *[F.sum(f"_n{i}").over(inner).alias(f"_e{i}") for i in range(n)])
    ranked = _join(ranked, targets.select(*by, *[f"_known{i}" for i in range(n)]), by)
    aggs = []
    for i, t in spots:
        rank = F.expr(f"(_known{i} - {1 - t}) div 2")
        here = (rank < F.col(f"_e{i}")) & (rank >= F.col(f"_e{i}") - F.col(f"_n{i}"))
        aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_y{i}{t}"))
    return ranked.groupBy(*by).agg(*aggs)


def group_median(df: DataFrame, by: Sequence[str], value, alias: str = "median", *,
                 count_alias: str | None = None, method: str = "distributed", **kw) -> DataFrame:
    """Median of ``value`` per group of ``by`` (see ``group_medians``): ``by`` +
    [alias] (+ ``count_alias``, the group's rows).

    ``method='builtin'`` uses Spark's exact ``percentile`` over the
    pre-aggregated value counts (fine when no group is large; kept as the
    yardstick for tests and benchmarks)."""
    by = list(by)
    if method == "builtin":
        counts = df.select(*by, _value(value).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
        out = counts.groupBy(*by).agg(F.percentile("_v", 0.5, F.col("_n")).alias(alias), F.sum("_n").alias("_rows"))
        return out.select(*by, alias, *([F.col("_rows").alias(count_alias)] if count_alias else []))
    if method != "distributed":
        raise ValueError("method must be 'distributed' or 'builtin'")
    out = group_medians(df, by, value, {"_m": None}, **kw)
    return out.select(*by, F.col("_m").alias(alias), *([F.col("_m_count").alias(count_alias)] if count_alias else []))
