"""One record per cluster: field by field, with provenance, conflicts and a stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "year", "language", "container", "type", "doi", "relation")


def empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def value_key(c: Column) -> Column:
    """Comparable form of a value: small letters, blanks squeezed, outer punctuation dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c.cast("string")), r"\s+", " ")), r"[.,;:\s]+$", "")


def merge(rows: DataFrame, key: str, priority: str, order: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The first non-empty value of each field by source priority, and which row gave it.

    Per field one partial aggregation; no cluster is gathered.  Adds ``<field>_from``
    (source and source_id) for provenance.
    """
    by = F.struct(priority, *order)
    aggs = []
    for f in fields:
        has = ~empty(F.col(f))
        aggs.append(F.min_by(F.when(has, F.struct(F.col(f).alias("v"), "source", "source_id")), F.when(has, by)).alias(f"_{f}"))
    # the abstract travels as a block with its rights and the address of its donor
    has = ~empty(F.col("abstract"))
    aggs.append(F.min_by(F.when(has, F.struct("abstract", "abstract_rights", F.col("url").alias("abstract_url"), "source", "source_id")), F.when(has, by)).alias("_abstract"))
    g = rows.groupBy(key).agg(*aggs, F.count("*").alias("n_rows"), F.array_sort(F.collect_set(F.struct("source", "source_id"))).alias("sources"))
    out = [key, "n_rows", "sources"]
    for f in fields:
        out += [F.col(f"_{f}.v").alias(f), F.concat_ws(":", f"_{f}.source", f"_{f}.source_id").alias(f"{f}_from")]
    return g.select(*out, "_abstract.abstract", "_abstract.abstract_rights", "_abstract.abstract_url", F.concat_ws(":", "_abstract.source", "_abstract.source_id").alias("abstract_from"))


def conflicts(rows: DataFrame, merged: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field, value, source, source_id) of every value that differs from the one that won."""
    long = rows.select(key, "source", "source_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "source", "source_id", "x.*")
    won = merged.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("won")) for f in fields])).alias("x")).select(key, "x.*")
    return long.where(~empty(F.col("value"))).join(won, [key, "field"]).where(value_key(F.col("value")) != value_key(F.col("won"))).select(key, "field", "value", "source", "source_id")


def rights_conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Clusters whose rows give one abstract under several rights: (key, texts, rights)."""
    r = rows.where(~empty(F.col("abstract"))).groupBy(key, F.sha1(F.trim("abstract")).alias("text")).agg(F.count_distinct("abstract_rights").alias("rights")).where("rights > 1")
    return r.groupBy(key).agg(F.count("*").alias("texts"), F.max("rights").alias("rights"))


def stable_ids(clusters: DataFrame, doi: str = "doi", title: str = "title_key", year: str = "year", author: str = "author_key") -> DataFrame:
    """Content-derived ids: DOI, else title, year and author, else the sources; ambiguous identities are told apart by all sources."""
    sig = F.array_join(F.transform(F.array_sort("sources"), lambda s: F.concat(s["source"], F.lit(":"), s["source_id"])), ";")
    ident = F.when(~empty(F.col(doi)), F.concat(F.lit("doi:"), F.col(doi))).when(~empty(F.col(title)) & F.col(year).isNotNull() & ~empty(F.col(author)), F.concat_ws("|", F.lit("tya"), title, F.col(year).cast("string"), author)).otherwise(F.concat(F.lit("src:"), sig))
    c = clusters.withColumn("_sig", sig).withColumn("_ident", ident)
    many = c.groupBy("_ident").agg(F.count("*").alias("_n"))
    c = c.join(many, "_ident").withColumn("identity", F.when(F.col("_n") > 1, F.concat("_ident", F.lit("#"), "_sig")).otherwise(F.col("_ident")))
    return c.withColumn("stable_id", F.concat(F.lit("W"), F.substring(F.sha1("identity"), 1, 12))).drop("_n", "_sig", "_ident")


class DuplicateKey(RuntimeError):
    """A key that must be unique is not."""


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` if the key is unique, else DuplicateKey with one example."""
    dup = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if dup:
        raise DuplicateKey(f"{key} {dup[0][0]!r} occurs {dup[0]['n']} times")
    return df


def merge_report(rows: DataFrame, clusters: DataFrame, conflict_rows: DataFrame) -> DataFrame:
    """One row: rows in, clusters out, collapsed, with several DOIs, with abstract, conflicts."""
    a = rows.agg(F.count("*").alias("rows_in"), F.count_distinct("doi").alias("dois"))
    b = clusters.agg(F.count("*").alias("clusters_out"), F.count_if(F.col("n_rows") > 1).alias("clusters_merged"), F.count("abstract").alias("with_abstract"))
    c = conflict_rows.agg(F.count("*").alias("conflicts"))
    one = [F.lit(1).alias("_k")]
    j = a.select("*", *one).join(b.select("*", *one), "_k").join(c.select("*", *one), "_k").drop("_k")
    return j.withColumn("collapsed", F.col("rows_in") - F.col("clusters_out"))
