"""Identifiers and keys as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from stemma.functions.text import fold, norm_title


def norm_doi(c: Column) -> Column:
    """Bare lower-case DOI: resolver and scheme dropped, escapes decoded ('+' kept), outer punctuation trimmed; null if none."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, r"^(?:https?://[^/]+/|doi:\s*)", "")
    t = F.when(t.contains("%"), F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", ""), r"[.,;:\"']+$", "")
    return F.when(t.rlike(r"^10\.[0-9]{4,}/.+"), t)


def doi_prefix(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def norm_isbn(c: Column) -> Column:
    """The 13 digits of a valid ISBN-10 or ISBN-13, else null (a wrong check digit, an ISSN)."""
    d = F.upper(F.regexp_replace(c, r"[^0-9Xx]", ""))
    val = lambda x: F.when(x == "X", 10).otherwise(F.try_to_number(x, F.lit("9")).cast("int"))
    ten = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + (F.lit(11) - i) * val(F.substr(d, i, F.lit(1))))
    weight = lambda i: F.when(i % 2 == 1, 1).otherwise(3)
    sum13 = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + weight(i) * F.substr(s, i, F.lit(1)).cast("int"))
    stem = F.concat(F.lit("978"), F.substring(d, 1, 9))
    from10 = F.concat(stem, ((F.lit(10) - sum13(stem, 12) % 10) % 10).cast("string"))
    return F.when(d.rlike("^[0-9]{9}[0-9X]$"), F.when(ten % 11 == 0, from10)).when(d.rlike("^[0-9]{13}$"), F.when(sum13(d, 13) % 10 == 0, d))


def record_isbns(isbn: Column, isbn_issn: Column) -> Column:
    """Distinct valid ISBNs of both fields, sorted."""
    both = F.concat(F.coalesce(isbn, F.array().cast("array<string>")), F.array(isbn_issn))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(both, norm_isbn))))


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
# Words before a volume number, and the pattern of a well-formed roman numeral.
VOLUME_WORDS = "vol|volume|volumen|volumi|bd|band|baende|t|tom|tome|tomo|tomos|teil|parte|part|pt|fasc|heft"
ROMAN_PATTERN = "m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"


def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral, by the subtractive rule, read from its end."""
    value = lambda ch: F.element_at(F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))]), ch)
    chars = F.reverse(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    step = lambda s, ch: F.struct(
        F.when(value(ch) < s["top"], s["total"] - value(ch)).otherwise(s["total"] + value(ch)).alias("total"), F.greatest(s["top"], value(ch)).alias("top")
    )
    return F.aggregate(chars, start, step, lambda s: s["total"])


def volume_signature(c: Column) -> Column:
    """Sorted distinct volume numbers that follow a volume word in the normalised title (arabic up to three digits, or a well-formed roman numeral)."""
    found = F.regexp_extract_all(norm_title(c), F.lit(rf"(?U)\b(?:{VOLUME_WORDS})\s+([0-9]{{1,3}}|(?=[ivxlcdm]){ROMAN_PATTERN})\b"), 1)
    n = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), F.try_to_number(x, F.lit("999")).cast("int")).otherwise(roman_to_int(x)))
    return F.array_sort(F.array_distinct(F.array_compact(n)))


_PARTICLES = ("de", "la", "van", "den", "der", "von", "di", "du", "del", "le", "da")


def surname_key(name: Column) -> Column:
    """Comparable surname: before the comma, else the words before trailing initials, else the last
    word; particles dropped; the first part of a double name with two letters or more."""
    n = F.regexp_replace(fold(name), r"\(.*?\)|\[.*?\]", " ")
    parts = F.filter(F.split(F.trim(F.regexp_replace(n, r"[\s.]+", " ")), " "), lambda x: x != "")
    words = F.filter(parts, lambda x: ~x.isin(*_PARTICLES) & (F.length(x) > 1))
    comma = F.filter(F.split(F.trim(F.regexp_replace(F.substring_index(n, ",", 1), r"[\s.]+", " ")), " "), lambda x: ~x.isin(*_PARTICLES) & (x != ""))
    initials_last = F.regexp_like(F.trim(fold(name)), F.lit(r"(?:^|[\s.])[a-z]\.?(?:\s(?:van|von|de|der|den|di|la|du))*$"))
    pick = F.when(n.contains(",") & (F.size(comma) > 0), F.element_at(comma, -1)).when(F.size(words) == 0, F.element_at(parts, -1)).when(initials_last, F.element_at(words, 1)).otherwise(F.element_at(words, -1))
    sub = F.filter(F.split(pick, r"[-‐]"), lambda x: F.length(x) >= 2)
    return F.when(F.size(parts) > 0, F.coalesce(F.get(sub, F.lit(0)), pick))


def first_author_key(authors: Column) -> Column:
    return surname_key(F.get(F.filter(authors.getField("name"), lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0)))


def notice_identifier(source: Column, source_id: Column, title: Column, author: Column, year: Column) -> Column:
    """source:id where both are known, else a hash of title, author and year."""
    h = F.substring(F.sha1(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(author, F.lit("")), F.coalesce(year.cast("string"), F.lit("")))), 1, 16)
    return F.coalesce(F.concat(source, F.lit(":"), source_id), h)


def payload_digest(*columns: Column) -> Column:
    """16 hex digits over the canonical text of the inputs; null and empty differ."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])), 1, 16)


@F.pandas_udf(IntegerType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words in the longest run that both texts share; only called on candidate pairs."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        p, q = x.split(), y.split()
        best, row = 0, [0] * (len(q) + 1)
        for w in p:
            prev = 0
            for j, v in enumerate(q, 1):
                row[j], prev = (prev + 1 if w == v else 0), row[j]
                best = max(best, row[j])
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def _run(x: list[str], y: list[str]) -> tuple[int, int, int]:
    best = (0, 0, 0)
    row = [0] * (len(y) + 1)
    for i, w in enumerate(x, 1):
        prev = 0
        for j, v in enumerate(y, 1):
            row[j], prev = (prev + 1 if w == v else 0), row[j]
            if row[j] > best[0]:
                best = (row[j], i, j)
    return best


_VOL = re.compile(rf"^(?:{VOLUME_WORDS})$")
_NUM = re.compile(rf"^(?:[0-9]{{1,3}}|(?=[ivxlcdm]){ROMAN_PATTERN})$")


@F.pandas_udf(BooleanType())
def same_designation(a: pd.Series, b: pd.Series) -> pd.Series:
    """A shared run of four words and twenty letters or more, without a volume word in it, and not
    followed on both sides by numbers that differ: one work under two numberings."""

    def one(x: str | None, y: str | None) -> bool:
        if not x or not y:
            return False
        p, q = x.split(), y.split()
        n, i, j = _run(p, q)
        run = p[i - n : i]
        if n < 4 or len(" ".join(run)) < 20 or any(_VOL.match(w) for w in run):
            return False
        nx, ny = p[i] if i < len(p) else "", q[j] if j < len(q) else ""
        return not (_NUM.match(nx) and _NUM.match(ny) and nx != ny)

    return pd.Series([one(x, y) for x, y in zip(a, b)])
