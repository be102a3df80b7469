"""Mixing sources to target weights.

Method: tokens are summed per source; the repetition rate of a source is its share
of the total over its tokens; each document is given out floor(rate) times plus
once more with the fraction as probability, decided by a seeded hash of its id, so
the draw is the same on any cluster.

The total defaults to the largest at which every source that has documents gets
its share without any rate above its ``max_repeats``.  With a larger total, rates
are capped and the actual shares tell what is missing.  Shares of sources without
documents are dealt to the others in proportion.  Documents of sources that are not
listed are left out.

Nothing is grouped by source but sums; the table of rates has one row per listed
source.

Defined cases: null sources are not listed ones; documents without tokens take
part but add nothing; an empty table gives an empty mixture and shares of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokens import TOKENIZER, token_counts
from stemma.session import materialize

SEED = 20_240_101
#: rate tables up to this many rows are broadcast
BROADCAST_ROWS = 10_000


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return materialize(token_counts(documents, "doc_id", "text", ("source",), path), "sizes")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, wanted_share, rate) of every listed source."""
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").fillna(0, ["docs", "tokens"])
    t = materialize(t, "targets")  # one row per listed source
    alive = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    served = t.agg(F.sum(alive)).first()[0] or 0.0
    t = t.withColumn("wanted_share", alive / F.lit(float(served)) if served else F.lit(0.0))
    room = F.when(F.col("wanted_share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("wanted_share"))
    if total_tokens is None:
        total_tokens = t.agg(F.min(room)).first()[0] or 0.0
    total = F.lit(float(total_tokens))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted_share") * total / F.col("tokens"))).otherwise(0.0)
    return t.withColumn("rate", rate)


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copy): one row per copy given out, ``copy`` from 0."""
    r = rates(sizes, targets, total_tokens).select("source", "rate", "max_repeats")
    side = F.broadcast(r) if r.count() <= BROADCAST_ROWS else r
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    n = F.least(F.col("max_repeats"), (whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)).cast("int"))
    j = sizes.join(side, "source").withColumn("copies", n).where("copies > 0")
    return j.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def shares(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """Target and actual share of every listed source."""
    m = mixture(sizes, targets, total_tokens, seed).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("copies"), F.max("copy").alias("top"))
    r = rates(sizes, targets, total_tokens).join(m, "source", "left").fillna(0, ["mixed_tokens", "copies"])
    r = materialize(r, "mixed")
    everything = F.lit(float(r.agg(F.sum("mixed_tokens")).first()[0] or 0))
    return r.select("source", "target_share", "wanted_share", "max_repeats", "docs", "tokens", "rate", "copies", "mixed_tokens", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0).alias("actual_share"), F.coalesce(F.col("top") + 1, F.lit(0)).alias("most_copies"))
