"""Rankings from both ends (W30, W32) and top groups by count.

An unpartitioned DENSE_RANK window would move every row into one task. Here each
row stands once for either end, with the number of the task that made it as a salt, and
a window per end and salt keeps the n best. Spark plans that as a WindowGroupLimit before the
shuffle, so a task passes on n rows (or values, with their ties) of each end and the input is
computed once. What is left is bounded by n and the salts, not by the data, and is ranked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resalekit.session import stage

#: Windows of an end: ties of one value are dealt to so many tasks.
SALTS = 32
END, SALT, RANK = "__rank_end", "__rank_salt", "__rank"


def _order(metric: str) -> list[Column]:
    """The best first: the largest where the row stands for the winners, else the smallest."""
    win = F.col(END) == 0
    return [F.when(win, F.col(metric)).desc(), F.when(~win, F.col(metric)).asc()]


def _both_ends(df: DataFrame, metric: str, n: int, rank: Column, order: list[Column]) -> DataFrame:
    """The rows with a metric that are among the ``n`` best of their end (0: largest) and salt."""
    rows = df.where(F.col(metric).isNotNull()).withColumn(SALT, F.spark_partition_id() % SALTS)
    rows = rows.withColumn(END, F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumn(RANK, rank.over(Window.partitionBy(END, SALT).orderBy(*order))).where(F.col(RANK) <= n).drop(RANK, SALT)


def two_sided_dense(df: DataFrame, metric: str, n: int = 10, *,
                    labels: tuple[str, str] = ("Winner", "Loser")) -> DataFrame:
    """Rows whose ``metric`` is among the n largest or n smallest distinct
    values (DENSE_RANK <= n from either end, ties kept). Adds ``bucket``
    (the winner label wins when both apply) and ``rank_in_bucket``.
    Rows with a NULL metric are not ranked. ``df`` is computed once, when this is called."""
    kept = stage(_both_ends(df, metric, n, F.dense_rank(), _order(metric)), "ranked-ends")
    # at most n values of each end and salt
    values = kept.select(END, metric).distinct()
    ranks = values.withColumn("_rank", F.row_number().over(Window.partitionBy(END).orderBy(*_order(metric)))).where(F.col("_rank") <= n)
    ranks = ranks.groupBy(metric).agg(F.min(END).alias("_end"), F.min_by("_rank", END).cast("long").alias("rank_in_bucket"))
    # <= 2 n rows. A value that both ends have counts for the winners, and each row of it once
    out = kept.join(F.broadcast(ranks), metric).where(F.col(END) == F.col("_end"))
    win, lose = labels
    return out.select(*df.columns, F.when(F.col("_end") == 0, F.lit(win)).otherwise(F.lit(lose)).alias("bucket"), "rank_in_bucket")


def two_sided_limit(df: DataFrame, metric: str, n: int = 10, *, key: str = "property_id",
                    labels: tuple[str, str] = ("Winner", "Loser"),
                    label_col: str = "category") -> DataFrame:
    """The n rows with the largest and the n with the smallest non-NULL
    ``metric`` (ties broken by ``key`` ascending so the cut is
    deterministic), labelled in ``label_col``."""
    order = [*_order(metric), F.col(key).asc()]
    kept = _both_ends(df, metric, n, F.row_number(), order)
    # n rows of each end and salt are ranked in one task
    kept = kept.withColumn(RANK, F.row_number().over(Window.partitionBy(END).orderBy(*order))).where(F.col(RANK) <= n)
    win, lose = labels
    out = kept.select(*df.columns, F.when(F.col(END) == 0, F.lit(win)).otherwise(F.lit(lose)).alias(label_col))
    return out.orderBy(F.col(metric).desc(), F.col(key).asc(), label_col)


def top_groups(df: DataFrame, group: str, n: int, *, count_alias: str = "sales_count",
               where: Column | None = None) -> DataFrame:
    """The n groups with the most rows (ties: group value ascending);
    grouped count with partial aggregation, then a bounded top-n."""
    src = df if where is None else df.where(where)
    counts = src.groupBy(group).agg(F.count(F.lit(1)).alias(count_alias))
    return counts.orderBy(F.col(count_alias).desc(), F.col(group).asc_nulls_last()).limit(n)
