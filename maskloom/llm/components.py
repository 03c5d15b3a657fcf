"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and minima over edges, so a node with a third of all edges is split by Spark like any
skewed join, and the links never leave the executors.  Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common


def _stars(pairs: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours, from rows (u, v) in both directions or one."""
    return common.materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) for every node that occurs in ``edges`` (columns a, b: long).

    Rounds grow with the logarithm of the longest path; if they don't suffice that is an error, never a partial result.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.materialise(e, "edges")
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _stars(both)
        # large star: neighbours above a node move to its least neighbour
        large = common.materialise(both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct(), "large-star")
        m2 = _stars(large)
        # small star: a node and its lower neighbours move to the least of them
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m2.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        e = common.materialise(small.distinct(), "small-star")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components_unconverged_after_{rounds}_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
