"""Connected components by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage


#: Broadcast hooks that are followed in a round after the first.
HOPS = 4


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b, both bigint, not null);
    component is the smallest id that can be reached. No edges: no rows.

    In a round each id hooks on to its smallest neighbour and edges are
    contracted, so at least one end of every edge goes: about log(ids) rounds.
    Hooks that are few enough to be broadcast are followed further at once, which takes fewer rounds.
    Neighbours are partially aggregated, so an id with very many costs no more.
    Each round is staged in the shared folder."""
    edges = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("c")), "hooks")
        small = broadcast_if_small(hook)
        if small is not hook:
            for _ in range(HOPS):
                hook = hook.join(small.toDF("c", "d"), "c").select("a", F.col("d").alias("c"))
            hook = stage(hook, "hooks")
            small = F.broadcast(hook)
        if labels is None:
            labels = hook.toDF("id", "component")
        else:
            labels = stage(labels.join(small.toDF("component", "c"), "component", "left").select(
                "id", F.coalesce("c", "component").alias("component")), "labels")
        new = edges.join(small, "a").select(F.col("c").alias("x"), F.col("b")).join(small.toDF("b", "d"), "b")
        new = new.select(F.least("x", "d").alias("a"), F.greatest("x", "d").alias("b")).filter("a <> b")
        edges = stage(new.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
