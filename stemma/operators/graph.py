"""The bipartite graph of publications, authors and containers; weights and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import discard, materialize


def edges(pubs: DataFrame, pub_id: str, node_key: str, kind: str, at_least: int = 1) -> DataFrame:
    """(src, dst, rel): distinct links to nodes that at least so many publications share."""
    e = pubs.where(F.col(node_key).isNotNull() & (F.col(node_key) != "")).select(F.col(pub_id).alias("src"), F.concat(F.lit(kind + ":"), node_key).alias("dst")).distinct()
    if at_least > 1:
        e = e.join(e.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("dst"), "dst")
    return e.select("src", "dst", F.lit(kind).alias("rel"))


def degrees(e: DataFrame) -> DataFrame:
    """(node, kind, degree) of both sides."""
    p = e.groupBy(F.col("src").cast("string").alias("node")).agg(F.count("*").alias("degree")).select("node", F.lit("pub").alias("kind"), "degree")
    return p.unionByName(e.groupBy(F.col("dst").alias("node"), F.col("rel").alias("kind")).agg(F.count("*").alias("degree")).select("node", "kind", "degree"))


def pagerank(e: DataFrame, rounds: int = 45, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, score) after a fixed number of rounds over the undirected graph.

    Mass of nodes without a link is not dealt out again.  Edges are kept once, in both
    directions, with the degree of their start; each round is one join and one
    aggregation; the ranks are written to the shared folder every few rounds.
    """
    und = e.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    both = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = both.groupBy("a").agg(F.count("*").alias("d"))
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written_links = materialize(both.join(deg, "a"), "links")
    # kept partitioned by their start, so that a round moves only what is handed on; a lost block is read from the table again
    links = written_links.repartition(parts, "a").persist()
    n = deg.count()
    base = (1 - damping) / max(n, 1)
    ranks = materialize(deg.select(F.col("a").alias("node"), F.lit(1.0 / max(n, 1)).alias("score")), "ranks")
    written = ranks
    for i in range(1, rounds + 1):
        got = links.join(ranks.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg((F.lit(base) + F.lit(damping) * F.sum(F.col("score") / F.col("d"))).alias("score"))
        ranks = got
        if i % every == 0 or i == rounds:
            ranks = materialize(got, "ranks")
            discard(written)
            written = ranks
    links.unpersist()
    discard(written_links)
    return ranks


def co_occurrence(df: DataFrame, row: str, values: str, at_least: int = 1) -> DataFrame:
    """(a, b, weight) of values that stand in one row's array, a < b: rows per pair.

    Arrays are short by their vocabulary (a handful of values), so pairs per row are bounded.
    """
    d = df.select(row, F.array_distinct(values).alias("v")).where("size(v) > 1")
    p = d.select(row, F.explode(F.expr("flatten(transform(v, x -> transform(filter(v, y -> y > x), y -> struct(x as a, y as b))))")).alias("p")).select(row, "p.*")
    return p.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= at_least)


def min_overlap(df: DataFrame, item: str, feature: str, at_least: int = 1) -> DataFrame:
    """(a, b, weight): sum of the lesser counts of the features two items share."""
    prof = df.groupBy(item, feature).agg(F.count("*").alias("n"))
    l, r = prof.alias("l"), prof.alias("r")
    j = l.join(r, F.col(f"l.{feature}") == F.col(f"r.{feature}")).where(F.col(f"l.{item}") < F.col(f"r.{item}"))
    return j.groupBy(F.col(f"l.{item}").alias("a"), F.col(f"r.{item}").alias("b")).agg(F.sum(F.least("l.n", "r.n")).alias("weight")).where(F.col("weight") >= at_least)


def top_trails(adjacency: DataFrame, k: int = 3) -> DataFrame:
    """The k heaviest neighbours of each end; ties go to the lesser name."""
    both = adjacency.select("a", "b", "weight").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    w = Window.partitionBy("a").orderBy(F.col("weight").desc(), "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_trails(adjacency: DataFrame, k: int = 3) -> DataFrame:
    """The links (a, b, weight) kept when the heaviest come first and no end takes more than ``k``; ties go to the lesser names.

    A link that is among the first undecided ones of both its ends, as many as these
    still have room for, is one that the sequence keeps; one of a full end it drops.  Both
    are decided at once in every round, and the heaviest undecided link always is, so the
    rounds end; in practice after a few.
    """
    left = materialize(adjacency.select("a", "b", "weight"), "links")
    kept: DataFrame | None = None
    while True:
        ends = left.select(F.col("a").alias("end"), "a", "b", "weight").unionByName(left.select(F.col("b").alias("end"), "a", "b", "weight"))
        full = kept.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("taken")) if kept is not None else None
        ends = ends.join(full, "end", "left") if full is not None else ends.withColumn("taken", F.lit(0))
        w = Window.partitionBy("end").orderBy(F.col("weight").desc(), "a", "b")
        both = ends.select("a", "b", "weight", (F.row_number().over(w) <= k - F.coalesce("taken", F.lit(0))).alias("first"), (F.coalesce("taken", F.lit(0)) >= k).alias("full")).groupBy("a", "b", "weight").agg(F.every("first").alias("keep"), F.some("full").alias("drop"))
        both = materialize(both, "round")
        new = both.where("keep").select("a", "b", "weight")
        kept = new if kept is None else kept.unionByName(new)
        discard(left)
        left = materialize(both.where("not keep and not drop").select("a", "b", "weight"), "links")
        if left.isEmpty():
            return kept


def adjacent_zones(adjacency: DataFrame, chosen: list[str], k: int = 3) -> DataFrame:
    """Neighbours of the chosen ones by summed weight, the chosen ones left out."""
    both = adjacency.select("a", "b", "weight").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.where(F.col("a").isin(chosen) & ~F.col("b").isin(chosen)).groupBy(F.col("b").alias("zone")).agg(F.sum("weight").alias("weight")).orderBy(F.col("weight").desc(), "zone").limit(k)


def homonyms(authors: DataFrame) -> DataFrame:
    """Name keys that stand for more than one authority number."""
    return authors.where("gnd is not null").groupBy("name_key").agg(F.count_distinct("gnd").alias("numbers")).where("numbers > 1")
