"""Connected components of a link table, by hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b`` long): the smallest node it reaches.

    Each round hooks a root to its smallest smaller neighbour, follows the hooks to
    their ends by doubling, and keeps only the links between different ends, so that
    the links shrink from round to round. Only counts come to the driver. Nodes with
    null and links of a node to itself count for nothing; no links give no rows.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    empty = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    labels = None
    while not edges.isEmpty():
        hooks = _to_the_end(written(edges.groupBy("u").agg(F.min("v").alias("to")), "hooks"))
        ends = hooks.select(F.col("u").alias("node"), F.col("to").alias("component"))
        if labels is None:
            labels = ends
        else:
            moved = labels.join(hooks, labels["component"] == hooks["u"], "left")
            labels = written(moved.select("node", F.coalesce("to", "component").alias("component")).union(ends), "labels")
        for side in ("u", "v"):
            end = hooks.select(F.col("u").alias("_from"), F.col("to").alias("_to"))
            edges = (edges.join(end, edges[side] == end["_from"], "left")
                          .withColumn(side, F.coalesce("_to", side)).drop("_from", "_to"))
        edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                             .distinct(), "links")
    if labels is None:
        return empty
    # Only nodes that were hooked to another have a row so far.
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return written(labels.union(roots), "components")


def _to_the_end(hooks: DataFrame) -> DataFrame:
    """Every hook moved on to the end of its chain of hooks."""
    while True:
        ahead = hooks.select(F.col("u").alias("_at"), F.col("to").alias("_next"))
        hooks = written(hooks.join(ahead, hooks["to"] == ahead["_at"], "left")
                             .select("u", F.coalesce("_next", "to").alias("to"),
                                     F.col("_next").isNotNull().alias("moved")), "hooks")
        if hooks.filter("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")
