"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps only replace edges by edges to smaller labels, so every round is one
shuffle on the node and the number of rounds grows with the logarithm of the
longest path.  The edge table of each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; ``edges`` has u > v."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Self-loops, repeated and null edges are ignored; nodes without an edge do not
    occur.  The result does not depend on the order of the rows.  Raises if the
    graph has not settled after ``max_rounds`` rounds (paths of about 2**max_rounds).
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v and u is not null and v is not null").distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        new = materialize(_star(_star(e, True), False), "edges")  # written whole before the last round is deleted
        # settled when no edge start has two ends and no end is itself a start
        bad = new.groupBy("u").count().where("count > 1").select("u").unionByName(new.select(F.col("v").alias("u")).join(new.select("u").distinct(), "u", "left_semi")).limit(1).count()
        discard(e)
        e = new
        if not bad:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
