"""Sinks: guarded, compacting and upserting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.gates import FORBIDDEN_KEYS, GateClosed, forbidden_paths
from stemma.operators.joins import first_non_empty
from stemma.operators.tags import compact


def guarded_json(df: DataFrame, path: str, keys: tuple[str, ...] = FORBIDDEN_KEYS, mode: str = "error") -> None:
    """Write line JSON unless the schema holds a forbidden key at any depth."""
    bad = forbidden_paths(df.schema, keys)
    if bad:
        raise GateClosed(f"fields that must not be published: {bad}")
    df.write.mode(mode).json(path)


def by_source(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet with one folder per source."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, fields: list[str], union: list[str]) -> DataFrame:
    """Rows of both by key: what exists wins, empty fields are filled, listed arrays united."""
    a = existing.withColumn("_gen", F.lit(0))
    b = new.withColumn("_gen", F.lit(1))
    return first_non_empty(a.unionByName(b, allowMissingColumns=True), key, ["_gen"], fields, union)


def compact_log(log: DataFrame, table_path: str, history_path: str) -> None:
    table, history = compact(log)
    table.write.mode("overwrite").parquet(table_path)
    history.write.mode("append").parquet(history_path)


def release(df: DataFrame, strip: bool = True, withdraw: str | None = None) -> DataFrame:
    """The public form: abstracts dropped, and rows whose rights match a pattern marked as withheld."""
    out = df
    if withdraw:
        gone = F.coalesce(F.col("abstract_rights").rlike(withdraw), F.lit(False))
        out = out.withColumn("abstract_withheld", gone & F.col("abstract").isNotNull()).withColumn("abstract", F.when(~gone, F.col("abstract")))
    if strip:
        out = out.drop(*[c for c in out.columns if c.lower() in ("abstract",)])
    return out


def union_files(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
