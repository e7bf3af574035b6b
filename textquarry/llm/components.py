"""Connected components by alternating large and small stars.

Every round is two grouped minima and two joins on vertices; the rows are edges, so
a hub is an ordinary skewed key whose join side Spark can split. Labels are the
least vertex of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import unbound, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: larger neighbours go to the least one; small: the rest do."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # (u, v) with v > u, that is the edges read upwards.
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(unbound(least, "u"), "u")
        out = up.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(unbound(least, "u"), "u")
        out = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all vertices of the edges (a, b); component: the least node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, name)
    seen = None
    while True:
        e = written(_star(_star(e, True), False), name)
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (mark.n, mark.h)
        if now == seen:
            break
        seen = now
    # In the end each edge leads from a vertex to the least of its component.
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
