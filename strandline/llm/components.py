"""Connected components by alternating large-star and small-star rounds, all in DataFrames.

Labels never leave the executors. Each round halves chains, so rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end, so u's row set holds its smaller neighbours only."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def component_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the least node reachable; nodes without an edge do not appear. Nulls are dropped."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct())
    seen = None
    while True:
        now = cut(_small_star(_large_star(now)))
        # A star forest is a fixed point; count and an order-free hash tell whether anything moved.
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            break
        seen = state
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return leaves.union(roots)
