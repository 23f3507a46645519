"""Connected components of a link table, as Spark jobs, for nodes of any ordered type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Far above what the alternating stars need (their rounds grow with the logarithm of a component's size).
MOST_ROUNDS = 1000


def _stars(pairs: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each node's neighbours on the given side are linked with the smallest of node and neighbours.
    pairs: node, other. The smallest is found by a grouping that is summed up before it is dealt out, and
    written, so that a node with very many neighbours can be split in the join that follows."""
    least = written(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "least")
    return pairs.join(least, "node")


def components(links: DataFrame, written: Callable[[DataFrame, str], DataFrame], most: int = MOST_ROUNDS) -> DataFrame:
    """links: a, b. node, component (the smallest node that links reach) for every node that has a link.
    Alternates large and small stars until nothing changes, and raises if that takes more than `most` rounds;
    every round is written to the shared folder, so lost executors cost at most a round. Links that are null
    or of a node with itself are left out."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = edges.agg(F.count(F.lit(1)), mark).first()
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _stars(both, written).where("other > node").select(F.col("least").alias("a"), F.col("other").alias("b")).where("a < b").distinct()
        large = written(large, "large")
        down = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        small = _stars(down, written)
        small = small.select(F.col("least").alias("a"), F.col("other").alias("b")).unionByName(small.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a < b").distinct()
        edges = written(small, "small")
        now = edges.agg(F.count(F.lit(1)), mark).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: still changing after {most} rounds")
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
