"""Connected components by repeated contraction, all on the cluster.

Each round gives every vertex the least vertex in its neighbourhood, follows two of
these pointers, and rewrites the edges between the vertices pointed at; loops and
duplicates go.  Edges shrink quickly, and only a count returns to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every vertex of (a, b), the root being one vertex of its component; None without edges."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct())
    known = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        step = low.select(F.col("node").alias("up"), F.col("up").alias("next"))
        far = materialize(low.join(step, "up").select("node", F.col("next").alias("up")))
        if known is None:
            known = far.withColumnRenamed("up", "root")
        else:
            jump = far.withColumnsRenamed({"node": "root", "up": "next"})
            known = known.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        a = far.withColumnsRenamed({"node": "a", "up": "x"})
        b = far.withColumnsRenamed({"node": "b", "up": "y"})
        edges = materialize(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return known
