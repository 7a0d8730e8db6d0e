"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sweep, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node that it reaches. Self-loops and repeated edges do no harm.

    Every step points nodes at smaller neighbours, with one minimum per node
    and one join; the edges end as stars around the roots. That they are stars
    shows in the minima: no node has two smaller neighbours, or smaller and
    larger ones. So edges that are stars when they come cost one minimum.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.select("u", "v").union(e.select("v", "u"))
        below, above = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), ((below > 1) | ((below > 0) & (above > 0))).alias("open"))
        least = written(nodes.select("u", F.least("u", "m").alias("m"), "open"))
        if not least.where("open").take(1):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(least.where("m = u").select("u", "u"))
        e = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        sweep(e.sparkSession)  # plans of finished steps stay in the driver's heap until a collection
        least = written(e.groupBy("u").agg(F.min("v").alias("m")))
        e = written(e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
