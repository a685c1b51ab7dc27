"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's (larger / no larger) neighbours are joined to the least of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    out = joined.where("b > a" if larger else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; root is the component's least node.

    Alternates large-star and small-star steps until nothing changes; each round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, after = None, sign(now)
    while after[0] and before != after:
        now = stored(_star(_star(now, True), False), "edges")
        before, after = after, sign(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
