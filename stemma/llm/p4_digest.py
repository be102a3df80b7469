"""Percentiles of very large numeric columns by merging centroid digests.

Method: a digest is a list of centroids (mean, weight) of sorted values, clustered
under the size function k(q) = delta / (2 pi) * asin(2 q - 1): a cluster spans at
most one unit of k, so clusters are small at both ends.  Digests of partitions are
merged by clustering their centroids again, in two levels, so that a group that
holds a third of all rows is digested by all tasks and no task sees more than the
centroids of its share.  Runs and days are combined the same way
(:func:`combine`).  A second pass over the values counts, for every percentile
given out, how many values lie below and at it, and so certifies its rank error.

Equal values are counted before they are digested.  Every task holds one running
digest and one buffer of ``BUFFER`` values, whatever the size of a group.

Defined cases: null and NaN values are left out; a group without values has no
row; ties have the rank interval from the values below to the values at most; an
empty table gives an empty table; key columns may be nested and null (null keys
are one group).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import materialize

#: compression: at most about DELTA / 2 + 2 centroids in a digest
DELTA = 400
BUFFER = 200_000
#: first-level merges of one group are spread over so many tasks
SPREAD = 32
#: percentile tables up to this many rows are broadcast for the counting pass
BROADCAST_ROWS = 20_000

PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def cluster(means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, ...]:
    """Cluster weighted values under the size function; the result is sorted by mean.

    Each cluster keeps its least and greatest value, so that a cluster of equal
    values (a tie) is known to be one.
    """
    order = np.argsort(means, kind="stable")
    m, w, lo, hi = means[order], weights[order], lows[order], highs[order]
    total = w.sum()
    if len(m) <= 2 or total <= 0:
        return m, w, lo, hi
    mid = (np.cumsum(w) - w / 2) / total
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * mid - 1, -1, 1)))
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ws = np.add.reduceat(w, starts)
    return np.add.reduceat(m * w, starts) / ws, ws, np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)


def quantile(means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, q: float) -> float:
    """The value at rank q: the value of a tie, else in proportion between the ends of its cluster."""
    cum = np.cumsum(weights)
    at = q * cum[-1]
    i = min(int(np.searchsorted(cum, at, side="left")), len(cum) - 1)
    if lows[i] == highs[i]:
        return float(lows[i])
    part = (at - (cum[i] - weights[i])) / weights[i]
    # through the mean, as half of the cluster lies on either side of it
    return float(np.interp(part, [0.0, 0.5, 1.0], [lows[i], means[i], highs[i]]))


class _Running:
    """The digest of the group a sorted task is reading."""

    def __init__(self) -> None:
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, m: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.kept.append((m, w, lo, hi))
        self.held += len(m)
        if self.held > BUFFER:
            self.kept = [self.done()]
            self.held = len(self.kept[0][0])

    def done(self) -> tuple[np.ndarray, ...]:
        return cluster(*(np.concatenate(c) for c in zip(*self.kept)))


_SCHEMA = "gid bigint, part int, means array<double>, weights array<double>, lows array<double>, highs array<double>"
_ARROW = pa.schema([("gid", pa.int64()), ("part", pa.int32()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])


def _emit(gid: int, part: int, r: _Running) -> pa.RecordBatch:
    m, w, lo, hi = (c.tolist() for c in r.done())
    return pa.RecordBatch.from_pylist([{"gid": gid, "part": part, "means": m, "weights": w, "lows": lo, "highs": hi}], schema=_ARROW)


def _digest_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, value, n) sorted by gid: one digest per group of this task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    current, run = None, _Running()
    for batch in batches:
        g = batch.column(0).to_numpy(zero_copy_only=False)
        v = batch.column(1).to_numpy(zero_copy_only=False)
        n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        if not len(g):
            continue
        cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if g[a] != current:
                if current is not None:
                    yield _emit(int(current), part, run)
                current, run = g[a], _Running()
            run.add(v[a:b], n[a:b], v[a:b], v[a:b])
    if current is not None:
        yield _emit(int(current), part, run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest rows sorted by gid (and part): merged digests, clustered again."""
    current, run, part = None, _Running(), 0
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["gid"], r["part"])
            if key != current:
                if current is not None:
                    yield _emit(current[0], current[1], run)
                current, run = key, _Running()
            run.add(*(np.array(r[c]) for c in ("means", "weights", "lows", "highs")))
    if current is not None:
        yield _emit(current[0], current[1], run)


def _merged(parts: DataFrame) -> DataFrame:
    """One digest per gid from any number of partial digests."""
    first = parts.withColumn("part", F.pmod(F.hash("part"), F.lit(SPREAD)))
    first = first.repartition("gid", "part").sortWithinPartitions("gid", "part").mapInArrow(_merge, _SCHEMA)
    last = first.withColumn("part", F.lit(0)).repartition("gid").sortWithinPartitions("gid")
    return last.mapInArrow(_merge, _SCHEMA)


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("gid", F.xxhash64(*[F.to_json(F.struct(k)) for k in keys])) if keys else df.withColumn("gid", F.lit(0).cast("bigint"))


def digests(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, means, weights, lows, highs, n): one digest per group, a form that can be stored and combined."""
    base = _named(df.select(*keys, F.col(value).cast("double").alias("value_")).where("value_ is not null and not isnan(value_)"), keys)
    groups = base.groupBy("gid").agg(*[F.first(k).alias(k) for k in keys], F.count("*").alias("n"))
    counted = base.groupBy("gid", "value_").agg(F.count("*").alias("n"))
    parts = counted.sortWithinPartitions("gid", "value_").mapInArrow(_digest_values, _SCHEMA)
    out = _merged(parts).drop("part").join(groups, "gid")
    return out.select(*keys, "means", "weights", "lows", "highs", "n")


def combine(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of runs or days combined into one per ``keys``, by clustering again."""
    base = _named(stored, keys)
    groups = base.groupBy("gid").agg(*[F.first(k).alias(k) for k in keys], F.sum("n").alias("n"))
    parts = base.select("gid", F.pmod(F.xxhash64("means", "n"), F.lit(1 << 20)).cast("int").alias("part"), "means", "weights", "lows", "highs")
    return _merged(parts).drop("part").join(groups, "gid").select(*keys, "means", "weights", "lows", "highs", "n")


def _quantiles(qs: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            vals = [[quantile(*d, q) for q in qs] for d in zip(*(map(np.array, rows[c]) for c in ("means", "weights", "lows", "highs")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vals, pa.list_(pa.float64()))], names=["gid", "vals"])

    return run


def percentiles(df: DataFrame, stored: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(keys, n, q, value, below, at_most, rank_error) of every group and percentile.

    ``rank_error`` is certified by counting: the distance of q from the share of
    values below to the share of values at most the one given out; 0 inside it.
    """
    d = materialize(_named(stored, keys), "digests")
    est = d.select("gid", "means", "weights", "lows", "highs").mapInArrow(_quantiles(qs), "gid bigint, vals array<double>")
    est = materialize(est, "estimates")
    base = _named(df.select(*keys, F.col(value).cast("double").alias("value_")).where("value_ is not null and not isnan(value_)"), keys)
    counted = base.groupBy("gid", "value_").agg(F.count("*").alias("n_"))
    side = F.broadcast(est) if est.count() <= BROADCAST_ROWS else est
    joined = counted.join(side, "gid")
    tally: list[Column] = []
    for i in range(len(qs)):
        tally.append(F.sum(F.when(F.col("value_") < F.col("vals")[i], F.col("n_")).otherwise(0)).alias(f"b{i}"))
        tally.append(F.sum(F.when(F.col("value_") <= F.col("vals")[i], F.col("n_")).otherwise(0)).alias(f"t{i}"))
    counts = joined.groupBy("gid").agg(*tally, F.sum("n_").alias("n"))
    rows = counts.join(est, "gid").join(d.select("gid", *keys), "gid")
    items = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col("vals")[i].alias("value"), F.col(f"b{i}").alias("below"), F.col(f"t{i}").alias("at_most")) for i, q in enumerate(qs)])
    out = rows.select(*keys, "n", F.explode(items).alias("p")).select(*keys, "n", "p.*")
    return out.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("at_most") / F.col("n")))


def mid_ranks(stored: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank): the share of the group below a value plus half of those at it, from the digest."""
    v = _named(values.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null").distinct(), keys).select("gid", "value")
    d = _named(stored, keys)
    j = v.join(d, "gid").withColumn("z", F.arrays_zip("weights", "lows", "highs"))
    # inside a mixed cluster values are taken as spread evenly
    inside = "case when x.highs < value then x.weights when x.lows > value then 0d when x.lows = x.highs then x.weights / 2 else x.weights * (value - x.lows) / (x.highs - x.lows) end"
    below = F.expr(f"aggregate(z, 0d, (s, x) -> s + {inside})")
    total = F.expr("aggregate(weights, 0d, (s, x) -> s + x)")
    return j.select(*keys, "value", (below / total).alias("rank"))
