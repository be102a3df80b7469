"""Joins with priorities and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(left: DataFrame, left_id: str, steps: list[tuple[str, DataFrame, Column | None]], value: str) -> DataFrame:
    """The value of the first step that finds one.

    Each step is (name, donors, extra condition); donors have the join columns of
    ``left`` they share with it and ``value``.  Adds ``value`` and ``method``.  Donors
    that disagree on a key are dropped before the join, so a step never multiplies rows.
    """
    out = left
    for name, donors, _ in steps:
        keys = [c for c in donors.columns if c != value]
        one = donors.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(f"_{name}"), F.max(value).alias("_hi")).where(F.col(f"_{name}") == F.col("_hi")).drop("_hi")
        out = out.join(one, keys, "left")
    found = [F.when(F.col(f"_{n}").isNotNull(), F.struct(F.col(f"_{n}").alias("v"), F.lit(n).alias("m"))) for n, _, _ in steps]
    pick = F.coalesce(*found)
    return out.select(*left.columns, pick["v"].alias(value), pick["m"].alias("method"))


def agreed(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with one distinct value; keys in conflict are dropped, not resolved."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")


def project_by_title(targets: DataFrame, donors: DataFrame, value: str) -> DataFrame:
    """Targets that take over ``value`` from donors of the same title, author and type.

    Both have title_key, author_key, type, year; types '?' and 'other' neither give nor
    take.  All donors in reach must agree; years must both be known and lie no further
    apart than the type allows (articles and reviews 0, others 1).
    """
    usable = F.col("title_key").isNotNull() & F.col("author_key").isNotNull() & (F.col("title_key") != "") & ~F.col("type").isin("?", "other") & F.col("year").isNotNull()
    d = donors.where(usable & F.col(value).isNotNull()).groupBy("title_key", "author_key", "type", F.col("year").alias("donor_year")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    gap = F.when(F.col("type").isin("article", "review"), 0).otherwise(1)
    j = targets.where(usable).join(d, ["title_key", "author_key", "type"]).where(F.abs(F.col("year") - F.col("donor_year")) <= gap)
    agg = j.groupBy(*targets.columns).agg(F.min("_lo").alias(value), F.max("_hi").alias("_hi"))
    return agg.where(F.col(value) == F.col("_hi")).drop("_hi")


def first_non_empty(df: DataFrame, key: str, order: list[str], fields: list[str], union: list[str] = ()) -> DataFrame:
    """Upsert by key: the first non-empty value of each field in ``order``; listed array fields are united."""
    struct = F.struct(*order)
    aggs = [F.min_by(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(f)), F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), struct)).alias(f) for f in fields]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(u, F.array().cast(df.schema[u].dataType)))))).alias(u) for u in union]
    return df.groupBy(key).agg(*aggs)


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Are two tables equal as bags of rows?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def donors(targets: DataFrame, givers: DataFrame, key: str, row: str, value: str) -> DataFrame:
    """(row, donor, donors, disputed): for each target the least giver of its key, how many there are, and whether their values differ.

    Givers are counted per key before they meet the targets, so a hot key costs one row.
    """
    g = givers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("donor"), F.count("*").alias("donors"), (F.min(value) != F.max(value)).alias("disputed"))
    return targets.join(g, key).select(row, "donor", "donors", "disputed")
