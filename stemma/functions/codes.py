"""Codes brought to one vocabulary: languages, types, years, decades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of language codes and the two-letter code they stand for.
LANGUAGES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "it": "it ita italian italiano", "es": "es spa spanish español",
    "pt": "pt por portuguese", "ru": "ru rus russian", "el": "el ell gre grc greek", "la": "la lat latin", "nl": "nl nld dut dutch", "he": "he heb hebrew", "ar": "ar ara arabic", "pl": "pl pol polish", "ca": "ca cat catalan",
}
# Raw types and the type they are counted as.
TYPES = {
    "article": "article journal-article articolo artikel aufsatz", "book": "book monograph edited-book livre libro buch", "chapter": "chapter book-chapter book-section incollection", "dissertation": "dissertation thesis phdthesis these tesi",
    "review": "review book-review recension rezension", "other": "other dataset report preprint",
}


def lookup(table: dict[str, str]) -> dict[str, str]:
    return {w: k for k, words in table.items() for w in words.split()}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in lookup(table).items() for x in kv])
    return F.try_element_at(m, F.lower(F.trim(c)))


def norm_lang(c: Column) -> Column:
    """Two-letter code; '?' for unknown and missing ones; of a composite the first."""
    return F.coalesce(_mapped(F.regexp_replace(c, r"[;,/|].*$", ""), LANGUAGES), F.lit("?"))


def norm_type(c: Column) -> Column:
    """Counted type; 'other' for an unknown one, '?' for a missing one."""
    return F.when(c.isNull() | F.trim(c).isin("", "?"), F.lit("?")).otherwise(F.coalesce(_mapped(c, TYPES), F.lit("other")))


def norm_year(*candidates: Column) -> Column:
    """The least of the candidates whose first four characters are a year from 500 to 2026."""
    years = F.array(*[F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int") for c in candidates])
    return F.array_min(F.filter(years, lambda y: (y >= 500) & (y <= 2026)))


def decade(year: Column) -> Column:
    return F.when(year.isNull(), F.lit("?")).otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def bucket_language(c: Column) -> Column:
    return F.when(c.isin("en", "de", "fr", "it", "es"), c).otherwise(F.lit("oth"))


def noise_bucket(c: Column) -> Column:
    """Three-valued flag kept apart: noise, kept, undecided."""
    return F.when(c.isNull(), "undecided").when(c, "noise").otherwise("kept")
