"""Connected components by alternating large-star and small-star rounds.

Both rounds are joins and aggregations on node ids, so no adjacency list and
no component is ever held by one task. A component of n nodes needs O(log n)
rounds; each round's edges are checkpointed, which keeps the lineage short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge names.

    ``component`` is the smallest node reachable. Self loops and repeated
    edges are allowed, edges with a null end are ignored. An empty input gives
    an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    current = checkpointed(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _mark(current)
    while seen[0]:
        current = checkpointed(_small_star(_large_star(current)))
        now = _mark(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = members.unionByName(roots)
    alone = loops.distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum, by which a fixpoint is seen."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)
