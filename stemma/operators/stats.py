"""Counts, series, crosstabs and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, key: str, lo: int, hi: int, step: int = 1) -> DataFrame:
    """Left join of the counts to a spine lo..hi; missing ones are 0."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias(key))
    rest = [c for c in counts.columns if c != key]
    return spine.join(counts, key, "left").fillna(0, rest).select(key, *rest)


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """One row per ``row``, a count per listed value; one aggregation, no second pass for the values."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values], F.count("*").alias("total"))


def top_labels(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """The k most frequent keys with their preferred label: the most frequent, then longest, then first spelling."""
    spelled = df.where(F.col(key).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    best = spelled.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("a"), (-F.length(label)).alias("b"), F.col(label).alias("label"))).alias("m"), F.sum("n").alias("count"))
    return best.select(key, F.col("m.label").alias("label"), "count").orderBy(F.col("count").desc(), key).limit(k)


def mode_label(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key; ties go to the least."""
    c = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("m"), F.sum("n").alias("total")).select(key, F.col("m.v").alias(value), (-F.col("m.neg")).alias("n"), "total")


def coverage(df: DataFrame, dims: list[str], has: Column) -> DataFrame:
    """(dim, value, n, covered) over each dimension, in one pass by grouping sets, and the whole."""
    base = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("?")).alias(d) for d in dims], has.cast("int").alias("_has"))
    g = base.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.coalesce(F.sum("_has"), F.lit(0)).alias("covered"))
    dim = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims], F.lit("all"))
    return g.select(dim.alias("dim"), F.coalesce(*dims, F.lit("all")).alias("value"), "n", "covered")


def facet(df: DataFrame, option: str, counted: Column, mentioned: Column) -> DataFrame:
    """Per option: rows counted and rows only mentioned."""
    return df.groupBy(option).agg(F.count_if(counted).alias("counted"), F.count_if(mentioned).alias("mentioned"))


def options(df: DataFrame, axes: tuple[str, ...], counts: Column) -> DataFrame:
    """(axis, option, mentioned, counted, mentioned_only): rows that have an option of the array columns, and those for which ``counts`` holds; an option counts once a row."""
    flat = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.array_distinct(a).alias("v")) for a in axes]))
    o = df.select(counts.alias("counts"), flat.alias("x")).select("counts", "x.axis", F.explode("x.v").alias("option"))
    return o.groupBy("axis", "option").agg(F.count("*").alias("mentioned"), F.count_if("counts").alias("counted")).withColumn("mentioned_only", F.col("counted") == 0)
