"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): label is the smallest node that edges (a, b) reach. Nodes without edges are absent.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges are stars.
    Both sides of each join are stored tables, so that a hub's edges, which meet one row, are dealt over
    several tasks by adaptive execution.
    """

    def least(of: DataFrame, at: str) -> DataFrame:
        return scratch.table(of.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), at)

    now = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark, step = seen, step + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both, f"{name}-low-{step}")
        large = scratch.table(both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-large-{step}")
        low = least(large, f"{name}-least-{step}")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.table(small, f"{name}-{step}")
        scratch.free(f"{name}-{step - 1}", f"{name}-low-{step}", f"{name}-large-{step}", f"{name}-least-{step}")
