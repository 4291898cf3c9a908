"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u long, v long)``; ``root`` is the smallest node reachable.

    Each round replaces edges by edges to the smallest known neighbour. Only two minima and one sorted, deduplicated
    edge table move per round, never a node's neighbour list, and the minima of nodes with very many edges are sent to where
    those edges are, so a hub with a third of all edges fills no task.
    Null ends, self loops and repeated edges add nothing. An empty edge table gives an empty result.
    """
    e = (
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    before = _signature(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = (
            join_heavy(both, low, "u", "n", 2 * before[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = large.where(F.col("u") != F.col("v"))
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = (
            join_heavy(large, low, "u", "n", 2 * before[0])
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("p"))
            .select(F.col("p.a").alias("u"), F.col("p.b").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        e = materialize(small, "edges")
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
