"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.tables import remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an edge, component being the smallest id it reaches.

    Nulls and loops are no edges; repeated edges count once. The edge table
    never leaves the executors; each round is written to the shared folder, so
    a lost executor costs no earlier round. The number of rounds grows with the
    logarithm of the longest chain.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        following = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        remove(now)
        now = following
    pairs = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component")).distinct()
