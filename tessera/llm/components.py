"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize


def _attach(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least member of u's neighbourhood, u included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable. edges: columns a, b.

    Only nodes with an edge to another node come out. Each round replaces every
    edge by one to a smaller neighbour; rows never outnumber the edges given.
    Raises if the graph has not settled after ``rounds`` rounds (its need is
    logarithmic in the longest path).
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        # settled: every u has one v, and no v has an edge down
        branching = now.groupBy("u").count().where("count > 1").select("u")
        deeper = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if branching.unionByName(deeper).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _attach(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _attach(large)
        small = (
            down.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = materialize(small, "edges")
    raise RuntimeError(f"components not settled after {rounds} rounds")
