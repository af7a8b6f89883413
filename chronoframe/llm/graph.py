"""Connected components by alternating large-star and small-star steps.

Each step is a partially aggregated minimum and an equi-join of two written
tables, which Spark can split where a node has many edges; the edge table is
written to the shared folder after every round, so nothing gathers on the driver
and a lost executor costs one round at most. Rounds grow with the logarithm of the
nodes; the last one changes nothing.

Cases: edges of a node to itself and repeated edges are ignored; no edges give no
rows; null nodes are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the component's least node."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    said = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == said or not state[0]:
            break
        said = state
        both = _both(now)
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        # large star: larger neighbours of u point to the least of u's neighbourhood
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: u and its smaller neighbours point to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        now = materialize(large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
