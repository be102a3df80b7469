"""Gates that refuse to publish: attribution, addresses, schema, keys, populations."""

from __future__ import annotations

import ipaddress
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StructType

SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,120}$"
FORBIDDEN_KEYS = ("abstract", "summary", "source_model", "run_id", "justification", "api_key")


class GateClosed(RuntimeError):
    """A publication rule is broken."""


def address_ok(url: str | None) -> bool:
    """A public http(s) address: no user, no backslash, a port in range, no private host, no '..' after decoding."""
    if not url or any(c in url for c in "\\ \t\n") or len(url) > 2000:
        return False
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return False
    if u.scheme not in ("http", "https") or not u.hostname or u.username is not None or (port is not None and not 0 < port < 65536):
        return False
    host = u.hostname
    try:
        if not ipaddress.ip_address(host).is_global:
            return False
    except ValueError:
        if "." not in host or host.endswith((".local", ".internal", ".localhost")) or ".." in host:
            return False
    path = u.path
    for _ in range(5):
        if ".." in path.split("/"):
            return False
        path, before = unquote(path), path
        if path == before:
            break
    return True


@F.pandas_udf(BooleanType())
def url_resolvable(s: pd.Series) -> pd.Series:
    return s.map(address_ok)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))


def attribution(records: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds ``status``: attributed, unknown_source, bad_host or no_url, by the policy of the record's source."""
    p = policy.select("source", F.col("hosts").alias("_hosts"), F.lit(True).alias("_known"))
    j = records.join(F.broadcast(p), "source", "left")  # the policy is a fixed table
    host = url_host(F.col("url"))
    fits = F.exists("_hosts", lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    status = F.when(F.col("_known").isNull(), "unknown_source").when(F.col("url").isNull(), "no_url").when(~F.coalesce(fits, F.lit(False)), "bad_host").otherwise("attributed")
    return j.withColumn("status", status).drop("_hosts", "_known")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``: the names of the rules a row breaks; a rule is a condition that must hold, null breaks it."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def tag_rules(relevances: tuple[str, ...]) -> dict[str, Column]:
    return {
        "notice_id": F.col("notice_id").rlike(r"^[^:]+:.+$"),
        "relevance": F.col("relevance").isin(*relevances),
        "none_reason": (F.col("relevance") == "none") | F.col("relevance_none_reason").isNull(),
        "works": F.size("works") <= 4,
        "themes": F.size("themes") <= 5,
        "approaches": F.size("approaches").between(0, 2),
        "confidence": F.col("confidence").between(0, 1),
        "distinct": F.size(F.array_distinct("themes")) == F.size("themes"),
        "digest": F.col("input_digest").rlike("^[0-9a-f]{16}$"),
        "tagged_at": F.col("tagged_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"),
    }


def forbidden_paths(t: DataType, keys: tuple[str, ...] = FORBIDDEN_KEYS, at: str = "") -> list[str]:
    """Fields of a schema, at any depth, whose name is or starts with a forbidden key."""
    out = []
    if isinstance(t, StructType):
        for f in t.fields:
            here = f"{at}.{f.name}" if at else f.name
            if any(f.name.lower().startswith(k) for k in keys):
                out.append(here)
            out += forbidden_paths(f.dataType, keys, here)
    elif isinstance(t, ArrayType):
        out += forbidden_paths(t.elementType, keys, at + "[]")
    elif isinstance(t, MapType):
        out += forbidden_paths(t.valueType, keys, at + "{}")
    return out


def require(condition: bool, message: str) -> None:
    if not condition:
        raise GateClosed(message)


def require_none(bad: DataFrame, message: str) -> None:
    """Raise with up to three examples if ``bad`` has a row."""
    rows = bad.limit(3).collect()
    if rows:
        raise GateClosed(f"{message}: {rows}")


def one_population(a: DataFrame, b: DataFrame) -> None:
    """Two figures of one population must be equal row for row."""
    require(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), "two surfaces count different populations")


def safe_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(SAFE_ID), F.lit(False)) & ~F.coalesce(c.contains(".."), F.lit(False))


def isbn_splits(clusters: DataFrame) -> DataFrame:
    """ISBNs found in several clusters and why: other volumes, a reissue, or unexplained.

    ``clusters`` has isbn, cluster, year, volume (string of the volume numbers).
    """
    g = clusters.groupBy("isbn").agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("volume").alias("volumes"), F.min("year").alias("lo"), F.max("year").alias("hi"), F.count("*").alias("n"))
    why = F.when(F.col("volumes") > 1, "volume").when(F.col("hi") - F.col("lo") > 1, "reissue").otherwise("unexplained")
    return g.where("clusters > 1").withColumn("why", why)


def projection_check(projected: DataFrame, measured: DataFrame, works: DataFrame) -> DataFrame:
    """(citation_id, donors, agreeing, holds): counts taken over by title, derived again.

    Both tables have doi and n; ``works`` gives title_key, author_key, type and year of a
    DOI.  Donors have the same title, author and type, another DOI, and a year no further
    away than the type allows.  They are counted per key, year and count before they meet.
    """
    key = ["title_key", "author_key", "type"]
    usable = F.col("title_key").isNotNull() & (F.col("title_key") != "") & F.col("author_key").isNotNull() & ~F.col("type").isin("?", "other") & F.col("year").isNotNull()
    w = works.where(usable)
    t = projected.select("citation_id", "doi", "n").join(w, "doi")
    g = measured.select("doi", "n").join(w, "doi").groupBy(*key, F.col("year").alias("g_year"), F.col("doi").alias("g_doi"), F.col("n").alias("g_n")).agg(F.count("*").alias("k"))
    gap = F.when(F.col("type").isin("article", "review"), 0).otherwise(1)
    m = t.join(g, key).where((F.col("doi") != F.col("g_doi")) & (F.abs(F.col("year") - F.col("g_year")) <= gap) & F.col("g_n").isNotNull()).groupBy("citation_id").agg(F.sum("k").alias("donors"), F.sum(F.when(F.col("g_n") == F.col("n"), F.col("k")).otherwise(0)).alias("agreeing"))
    out = projected.select("citation_id").join(m, "citation_id", "left").fillna(0, ["donors", "agreeing"])
    return out.withColumn("holds", F.col("agreeing") > 0)
