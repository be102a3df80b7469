"""Ranks, cohorts and weights as window expressions.

Ranks come as integer numerator and denominator, so that nothing depends on the
rounding of an engine; :func:`ratio` gives the figure for display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, digits: int = 4) -> Column:
    return F.bround(num / den, digits)


def mid_rank(df: DataFrame, keys: list[str], value: str, num: str = "rank_num", den: str = "rank_den") -> DataFrame:
    """Mid-rank percentile (below + at most) / 2n in every group: ties share it, it lies inside ]0, 1[.

    Values are counted per (keys, value) first; the window then runs over distinct
    values, so a hot group costs its distinct values, not its rows.  Null values
    get null ranks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranks = counted.select(*keys, value, (2 * below + F.col("_n")).alias(num), (2 * total).alias(den))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, value]]
    j = df.alias("a").join(ranks.alias("b"), cond, "left")
    return j.select("a.*", F.col(f"b.{num}").alias(num), F.col(f"b.{den}").alias(den))


def cohort_ladder(df: DataFrame, levels: list[tuple[str, list[str]]], value: str, minimum: int = 8) -> DataFrame:
    """Rank inside the first level of the ladder whose cohort has ``minimum`` measured rows.

    Adds cohort_level, cohort_size, rank_num, rank_den; a row without a value has none (unmeasured is not 0).
    """
    out = df
    for i, (_, keys) in enumerate(levels):
        out = mid_rank(out, keys, value, f"_num{i}", f"_den{i}")
    enough = [F.col(f"_den{i}") >= 2 * minimum if i < len(levels) - 1 else F.col(f"_den{i}").isNotNull() for i in range(len(levels))]

    def pick(of) -> Column:
        return F.coalesce(*[F.when(e, of(i)) for i, e in enumerate(enough)])

    out = out.withColumn("cohort_level", pick(lambda i: F.lit(levels[i][0]))).withColumn("cohort_size", pick(lambda i: (F.col(f"_den{i}") / 2).cast("bigint")))
    out = out.withColumn("rank_num", pick(lambda i: F.col(f"_num{i}"))).withColumn("rank_den", pick(lambda i: F.col(f"_den{i}")))
    return out.drop(*[f"_{x}{i}" for x in ("num", "den") for i in range(len(levels))])


def min_rank_percentile(df: DataFrame, keys: list[str], value: str, name: str = "pct") -> DataFrame:
    """First position of the value over n - 1, from 0 to 1; 0.5 in a group of one.  Adds {name}_num and {name}_den."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    r = counted.select(*keys, value, F.when(total < 2, 1).otherwise(below).alias(f"{name}_num"), F.when(total < 2, 2).otherwise(total - 1).alias(f"{name}_den"))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, value]]
    return df.alias("a").join(r.alias("b"), cond, "left").select("a.*", f"b.{name}_num", f"b.{name}_den")


def weight(cited: Column, structural: Column) -> Column:
    """Mean of the citation and the structural percentile; the structural one alone, flagged, where nothing was measured."""
    return F.struct(F.when(cited.isNull(), structural).otherwise((cited + structural) / 2).alias("weight"), cited.isNull().alias("not_cited"))


def weight_tier(w: Column) -> Column:
    return F.when(w < 0.2, 1).when(w < 0.4, 2).when(w < 0.6, 3).when(w < 0.8, 4).otherwise(5)
