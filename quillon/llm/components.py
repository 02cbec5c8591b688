"""Connected components of links that are too many for one machine: alternating large and small stars.

Each round points every row's larger neighbours, then its smaller ones, at the
smallest; rounds end when the links no longer change, after about the logarithm
of the longest chain. Minima are pre-aggregated, so a node with very many links
costs one row per task, and the joins may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash of the links."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in links (a, b); self-links count as none."""
    edges = checkpointed(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


class Forest:
    """Union-find over 0..n-1, for the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
