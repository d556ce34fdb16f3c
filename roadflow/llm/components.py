"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Large and small stars alternate: each node hands its larger neighbours the
    smallest node it knows, then its smaller ones, until the table of links is
    one star per component.  A round is two aggregates with map-side
    combination and two joins, whose hot keys Spark splits; it ends in a written
    table.  Nodes without a link to another node are their own component; an
    empty table has none.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = cut_lineage(both.distinct())  # used twice below
    alone = both.where("a = b").select(F.col("a").alias("node"))
    stars = both.where("a <> b")
    known = _fingerprint(stars)
    while True:
        around = stars.union(stars.select("b", "a"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars_large = larger.where("a <> b").distinct()
        least = stars_large.groupBy("a").agg(F.min("b").alias("m"))
        smaller = stars_large.join(least, "a")
        hung = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m"))
        stars = cut_lineage(hung.distinct())
        state = _fingerprint(stars)
        if state == known:
            break
        known = state
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    linked = nodes.union(roots)
    single = alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.union(single)


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a", "b").cast("long"))).first())
