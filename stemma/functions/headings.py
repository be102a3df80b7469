"""Subject headings, aliases, author strings and notices typed as one line."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from stemma.functions.text import fold, squeeze

_TEMPORAL = r"(?i)^(?:to|until|bis|jusqu).*\d|^\d{1,4}\s*[-–]\s*\d{0,4}$|\d(?:st|nd|rd|th) century|jahrhundert|siècle|geschichte \d"


def clean_headings(c: Column) -> Column:
    """array<string> from headings divided by ';': what follows '--' or ' / ' is cut, angle brackets
    become round ones, dates and lengths outside 2 to 60 are dropped, repeats kept once in order."""
    parts = F.split(c, ";")
    one = lambda x: squeeze(F.translate(F.regexp_replace(F.regexp_replace(x, r"\s*--.*$", ""), r"\s+/\s.*$", ""), "<>", "()"))
    return F.array_distinct(F.filter(F.transform(parts, one), lambda x: F.length(x).between(2, 60) & ~x.rlike(_TEMPORAL)))


def subjects(*fields: Column) -> Column:
    """Union of indexing fields, each an array of strings, in the order of the fields."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in fields])))


def alias_index(vocabulary: DataFrame, shortest: int = 4) -> DataFrame:
    """(alias, keys): folded labels and aliases of four letters or more and the keys they may stand for.

    ``vocabulary`` has key, label and aliases array<string>.
    """
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    a = vocabulary.select("key", F.explode(names).alias("n")).select("key", squeeze(fold(F.col("n"))).alias("alias"))
    return a.where(F.length("alias") >= shortest).groupBy("alias").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def descriptors(c: Column) -> Column:
    """array<struct<weight,term>> from lines such as '*Term' (main, weight 2) and 'Term' (weight 1)."""
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.when(x.startswith("*"), 2).otherwise(1).alias("weight"), F.trim(F.regexp_replace(x, r"^\*", "")).alias("term")))


_INITIALS = re.compile(r"^(?:[^\W\d_]\.[-\s]?)+$")


def authors_of(line: str | None) -> list[str]:
    """Names of a line such as 'A. Ek, B. C. Ny - Uta Zoll': pieces that are initials only wait for the word that completes them."""
    if not line:
        return []
    out: list[str] = []
    pending = ""
    for piece in re.split(r"\s+[-–—]\s+|,|;|\s+(?:et|and|und|e|y|&)\s+", line):
        p = " ".join(piece.split())
        if not p:
            continue
        if _INITIALS.match(p):
            if out and not pending and " " not in out[-1] and "." not in out[-1]:
                out[-1] = f"{out[-1]}, {p}"  # 'Ek, A.' written with its comma
            else:
                pending = f"{pending} {p}".strip()
            continue
        out.append(f"{pending} {p}".strip())
        pending = ""
    if pending:
        out.append(pending)
    return out


@F.pandas_udf(ArrayType(StringType()))
def split_authors(s: pd.Series) -> pd.Series:
    return s.map(authors_of)


# the reference part of a notice, tried in order: 'in Container n (year) pages', 'Container n (year)', 'Place: Publisher year', 'Place year', a year
_TAILS = (
    re.compile(r"[,.]\s+(?:in|In)[:\s]\s*(?P<ref>.+\(\d{4}\).*)$"),
    re.compile(r"[,.]\s+(?P<ref>[^\W\d_][^,.]*\s\d+\s*\(\d{4}\).*)$"),
    re.compile(r"[,.]\s+(?P<ref>[^\W\d_][\w\s.-]*:\s*[^,]+,?\s*\d{4}.*)$"),
    re.compile(r"[,.]\s+(?P<ref>[^\W\d_][\w\s-]*\s\d{4}(?:,.*)?)$"),
    re.compile(r"\s+(?P<ref>\(?\d{4}\)?\.?)$"),
)


def notice_parts(line: str | None) -> tuple[str, str, str, int | None]:
    """(authors, title, reference, year) of a notice typed as one line: 'Authors, Title, reference'."""
    if not line or not line.strip():
        return "", "", "", None
    text = " ".join(line.split())
    ref = ""
    for t in _TAILS:
        m = t.search(text)
        if m:
            ref, text = m.group("ref").strip(" ."), text[: m.start()].strip(" ,.")
            break
    m = re.match(r"^(?P<who>(?:(?:[^\W\d_]\.\s?)+[^\W\d_][\w’'-]+(?:\s*[-–]\s*|,\s+|\s*$))+)(?P<rest>.*)$", text)
    who, title = (m.group("who").strip(" ,-–"), m.group("rest").strip()) if m and m.group("rest").strip() else ("", text)
    year = re.findall(r"\b(1[5-9]\d\d|20[0-2]\d)\b", ref)
    return who, title, ref, int(year[-1]) if year else None


NOTICE = StructType([StructField("authors", StringType()), StructField("title", StringType()), StructField("reference", StringType()), StructField("year", StringType())])


@F.pandas_udf(NOTICE)
def split_notice(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(a, t, r, None if y is None else str(y)) for a, t, r, y in map(notice_parts, s)], columns=["authors", "title", "reference", "year"])
