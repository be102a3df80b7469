"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import checked, p1_neardup, p2_visual, p3_names, p4_queries, p5_encoding, p6_survivor, p7_packing, p8_mixing, p9_toxicity
from stemma.session import materialize, scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_neardup.pairs_of(p1_neardup.groups(table(spark, d, "corpus")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return p1_neardup.groups(table(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_visual.found(table(spark, d, "corpus"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return p2_visual.canonical_forms(table(spark, d, "corpus"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_names.found(table(spark, d, "corpus"), table(spark, d, "authority"))


def p3_resolved(spark: SparkSession, d: str) -> DataFrame:
    return p3_names.resolve(table(spark, d, "corpus"), table(spark, d, "authority"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_encoding.found(table(spark, d, "corpus"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return p5_encoding.restored(table(spark, d, "corpus"))


def _p6_claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = table(spark, d, "corpus")
    groups = p1_neardup.groups(corpus)  # a table already
    return corpus, groups, p6_survivor.claims(corpus, groups)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        _, _, claimed = _p6_claims(spark, d)
        return keep(p6_survivor.found(claimed, p6_survivor.fuse(claimed)[0]), "alone")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        corpus, groups, claimed = _p6_claims(spark, d)
        return keep(p6_survivor.survivors(corpus, table(spark, d, "source_policy"), claimed, groups), "survivors")


def p7_packing_windows(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.pack(p7_packing.document_sizes(table(spark, d, "documents")))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.fill_report(materialize(p7_packing_windows(spark, d), "packed"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return p8_mixing.mixture(p8_mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return p8_mixing.shares(p8_mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_toxicity.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return p9_toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return p9_toxicity.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p3_found": p3_found,
    "p3_resolved": p3_resolved,
    "p4_percentiles": p4_queries.p4_percentiles,
    "p4_digests": p4_queries.p4_digests,
    "p4_combined": p4_queries.p4_combined,
    "p4_rank_check": p4_queries.p4_rank_check,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_packing": p7_packing_windows,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    **checked.QUERIES,
}

#: the operators themselves are tested against brute force, round trips and held-out cases
SQL: dict[str, str] = dict(checked.SQL)
