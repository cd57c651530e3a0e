"""Connected components by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merges components.  ``labels``: (id, comp), a comp being the smallest id of its members; ``links``: (a, b) ids.

    Works on the graph of components: each is hooked to its smallest neighbour, then paths are halved until every
    component points at a root; repeated until no link joins two components.  Only links whose ends still differ are
    carried on, and every round is written to the shared folder.
    """
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    edges = cut(ends.where("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct())
    if edges.isEmpty():
        return labels
    parent = None  # (id, to) for components that have moved
    while True:
        hook = edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("to"))  # to < id, so there is no cycle
        while True:
            step = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.id"), "left")
            hook = cut(step.select(F.col("x.id").alias("id"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            moved = not hook.where("moved").isEmpty()
            hook = hook.select("id", "to")
            if not moved:
                break
        if parent is None:
            parent = hook
        else:
            old = parent.join(hook.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("to"))
            parent = cut(old.unionByName(hook.join(old.select("id"), "id", "left_anti")))
        at = hook.select(F.col("id").alias("u"), F.col("to").alias("tu"))
        bt = hook.select(F.col("id").alias("v"), F.col("to").alias("tv"))
        moved_edges = edges.join(at, "u", "left").join(bt, "v", "left").select(F.coalesce("tu", "u").alias("p"), F.coalesce("tv", "v").alias("q"))
        edges = cut(moved_edges.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if edges.isEmpty():
            break
    out = labels.join(parent.select(F.col("id").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return cut(out)
