"""Percentiles of citation counts per cohort and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import p4_digest
from stemma.session import materialize, table

RUN = ["decade", "type", "lang", "run_id"]
COHORT = ["decade", "type", "lang"]
#: the cohorts a rank is reported in, the widened ones last
LEVELS = ("decade+type+lang", "decade+type", "decade")


def measured(spark: SparkSession, d: str) -> DataFrame:
    """One row per work, run and cohort: repeated deliveries of a measurement count once."""
    c = table(spark, d, "citations").where("measured and cited_by_count is not null")
    c = c.select("work_id", "run_id", "cohort.decade", "cohort.type", "cohort.lang", "cited_by_count", "cohort_rank", "cohort_level")
    return c.groupBy("work_id", "run_id", "decade", "type", "lang").agg(F.max(F.struct("cited_by_count", "cohort_rank", "cohort_level")).alias("m")).select("work_id", "run_id", "decade", "type", "lang", "m.*")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every cohort in every run, with certified rank errors."""
    m = materialize(measured(spark, d), "measured")  # read by the digests and by the counting pass
    return p4_digest.percentiles(m, p4_digest.digests(m, RUN, "cited_by_count"), RUN, "cited_by_count")


def p4_digests(spark: SparkSession, d: str) -> DataFrame:
    """The stored form: one digest per cohort and run."""
    return p4_digest.digests(measured(spark, d), RUN, "cited_by_count")


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per cohort over all runs, from the runs' digests alone, certified by counting."""
    m = materialize(measured(spark, d), "measured")
    return p4_digest.percentiles(m, p4_digest.combine(p4_digest.digests(m, RUN, "cited_by_count"), COHORT), COHORT, "cited_by_count")


def rank_check(m: DataFrame) -> DataFrame:
    """Reported ranks of ``measured`` rows beside the mid-ranks of the digest of their cohort, at each level."""
    stored = materialize(p4_digest.digests(m, RUN, "cited_by_count"), "digests")
    out = []
    for level in LEVELS:
        parts = level.split("+")
        keys = [*parts, "run_id"]
        rows = m.where(F.col("cohort_level") == level)
        # a widened cohort holds every work of its run with these keys, so the digests of its parts are combined
        ranks = p4_digest.mid_ranks(stored if parts == COHORT else p4_digest.combine(stored, keys), rows, keys, "cited_by_count")
        rep = rows.where("cohort_rank is not null").groupBy(*keys, F.col("cited_by_count").cast("double").alias("value")).agg(F.count("*").alias("n"), F.min("cohort_rank").alias("reported_min"), F.max("cohort_rank").alias("reported_max"))
        cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.value") == F.col("b.value")]
        named = [F.col(f"a.{k}") if k in keys else F.lit(None).cast("string").alias(k) for k in RUN]
        out.append(rep.alias("a").join(ranks.alias("b"), cond).select(F.lit(level).alias("cohort_level"), *named, F.col("a.value"), "n", "reported_min", "reported_max", F.col("b.rank").alias("digest_rank")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def p4_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Digest mid-ranks beside the reported cohort_rank; keys a widened cohort does not use are null."""
    return rank_check(materialize(measured(spark, d), "measured"))
