"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two joins whose lookup side is unique; the edges are
checkpointed to the shared folder after each round, and only a count and a hash sum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` that has a link to another: the smallest node reachable.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows. Nodes without a
    link don't appear: each is its own component.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpoint(now)
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
