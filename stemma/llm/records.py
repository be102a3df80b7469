"""Corpus rows brought to comparable parts, once, for the record problems.

``normalised`` gives one row per corpus row: the folded title and its words, the
volume, review and cut-off marks, author keys, the plain DOI and the natural keys.
It is written to the shared folder and read by every later stage.

Defined cases: null fields give empty parts; rows of an empty table give an empty
table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import names
from stemma.llm.encoding import repair
from stemma.llm.names import strip_marks
from stemma.llm.visual import canonical

#: folded words and word heads are hashed into so many buckets: the size bound of the rarity tables
WORD_BUCKETS = 1 << 18

# Marks that cataloguers add to titles, words for volumes and reviews.
_TRAILERS = re.compile(
    r"\s*(?:\[(?!\s*(?:\.\.\.|…))[^\[\]]{2,40}\]|\((?:pp?\.|s\.)\s*[\d–—-]+\)|\((?:sic|print|online)\)|\([^()\d†]{4,40}\s\d{1,3}\)|/)\s*$", re.I
)
_ENDS = frozenset(")]/.… ")
_CUT = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…)\s*$")
_VOLUME = re.compile(r"\b(?:vol|volume|band|bd|tome|tomo|tom|tomus|τομος|том|teil|часть)\b\.?\s*([ivxlc]{1,6}|\d{1,3})\b")
_REVIEW = re.compile(r"^\W*(?:review of|book review|rezension(?:\s+zu)?|recensione (?:a|di)|compte rendu de|resena de|recensao (?:a|de)|resenha de|рецензия на|βιβλιοκρισια|recensio)\b")
#: first letters of the words of _REVIEW
_REVIEW_STARTS = frozenset("brcрβ")
_REVIEW_MARK = re.compile(r"\((?:cr|rec\.?|review|recensione|rezension)\)")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_WORD = re.compile(r"[^\W_]+")
#: byte -> small letter, digit, or blank
_BLANKED = bytes(o if chr(o).isalnum() else 32 for o in map(ord, map(str.lower, map(chr, range(128))))) + bytes(range(128, 256))
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_ABSENT = re.compile(r"^\W*(?:no abstract available|abstract|tba|n/?a|see full text|kein abstract|résumé non disponible|abstract not supplied|not available|none|null|without abstract|sans résumé|sin resumen)?\W*$", re.I)

SCHEMA = (
    "record_id bigint, nat array<bigint>, year int, doi string, cls bigint, title string, words array<int>, vol int, "
    "review boolean, cut boolean, surnames array<string>, authors string, container string, isbn string"
)
_MADE = pa.schema([
    ("cls", pa.int64()), ("title", pa.string()), ("words", pa.list_(pa.int32())), ("vol", pa.int32()), ("review", pa.bool_()), ("cut", pa.bool_()),
    ("surnames", pa.list_(pa.string())), ("authors", pa.string()), ("container", pa.string()), ("isbn", pa.string()),
])
#: separators of flattened lists and of their parts
LIST, PART = "\x1e", "\x1f"


def roman(s: str) -> int:
    total = 0
    for a, b in zip(s, s[1:] + " "):
        v = _ROMAN[a]
        total += -v if b in _ROMAN and _ROMAN[b] > v else v
    return total


def h64(s: str) -> int:
    v = xxhash.xxh3_64_intdigest(s)
    return v - (1 << 64) if v >= 1 << 63 else v


@lru_cache(maxsize=200_000)
def grams(word: str) -> tuple[int, ...]:
    """The buckets of a word's n-grams: the set of letters of a word, or of each half of a long one.

    Swapped and doubled letters leave a set of letters as it is; another slip changes one half only.
    """
    if len(word) < 8:
        parts = ("".join(sorted(set(word))) if len(word) > 4 else word,)
    else:
        half = len(word) // 2
        parts = ("<" + "".join(sorted(set(word[:half]))), ">" + "".join(sorted(set(word[half:]))))
    return tuple(xxhash.xxh3_64_intdigest(p) % WORD_BUCKETS for p in parts)


def word_bucket(word: str) -> int:
    """The bucket of a whole word; equals pmod(xxhash64(word), WORD_BUCKETS) in SQL."""
    v = xxhash.xxh64_intdigest(word, 42)
    return (v - (1 << 64) if v >= 1 << 63 else v) % WORD_BUCKETS


def _words(f: str) -> list[str]:
    """The words of a folded text, as ``_WORD`` finds them."""
    return f.encode().translate(_BLANKED).decode().split() if f.isascii() and f == f.lower() else _WORD.findall(f)


def title_parts(title: str | None) -> tuple[str, int | None, bool, bool]:
    """(folded words, volume, review?, cut off?)."""
    if not title:
        return "", None, False, False
    t = (title if title.isascii() and "&" not in title else canonical(repair(title)[0])).strip()
    cut = False
    for _ in range(4):
        if t[-1:] in _ENDS:
            m = _TRAILERS.search(t)
            if m and m.start() > 0:
                t = t[: m.start()]
                continue
            m = _CUT.search(t)
            if m:
                cut, t = True, t[: m.start()]
                continue
        break
    f = strip_marks(t)
    review = False
    m = _REVIEW.match(f) if f[:1] in _REVIEW_STARTS or not f[:1].isalnum() else None
    if m:
        review, f = True, f[m.end() :]
    if "(" in f and _REVIEW_MARK.search(f):
        review, f = True, _REVIEW_MARK.sub(" ", f)
    # the beginnings of the words of _VOLUME, looked for before the pattern is run
    m = _VOLUME.search(f) if "vol" in f or "band" in f or "bd" in f or "tom" in f or "teil" in f or "τομ" in f or "том" in f or "част" in f else None
    vol = None
    if m:
        v = m.group(1)
        vol = int(v) if v.isdigit() else roman(v)
        f = f[: m.start()] + " " + f[m.end() :]
    return " ".join(_words(f)), vol, review, cut


def plain_doi(doi: str | None) -> str | None:
    if not doi:
        return None
    m = _DOI.search(doi.strip().lower())
    return m.group().rstrip(".,;:\"'") if m else None


_DECODED = "lower(case when contains(doi, '%') then coalesce(try_url_decode(replace(doi, '+', '%2B')), doi) else doi end)"
#: the same in SQL, escapes decoded before
PLAIN_DOI = "nullif(regexp_extract(" + _DECODED + ", '(10[.][0-9]{4,9}/[^ \\\\t\\\\n]*[^ \\\\t\\\\n.,;:\"\\'])', 1), '')"


def isbn13(s: str | None) -> str | None:
    """The 13 digits of an ISBN with a right check digit, else None."""
    if not s:
        return None
    d = re.sub(r"[^0-9Xx]", "", s).upper()
    if len(d) == 10 and d[:9].isdigit():
        if sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(d)) % 11 == 0:
            d = "978" + d[:9]
            return d + str(-sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(d)) % 10)
        return None
    if len(d) == 13 and d.isdigit() and sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(d)) % 10 == 0:
        return d
    return None


def placeholder(abstract: str | None) -> bool:
    return abstract is None or bool(_ABSENT.match(abstract))


@lru_cache(maxsize=50_000)
def _folded(s: str) -> str:
    return " ".join(_words(strip_marks(canonical(s))))


@lru_cache(maxsize=200_000)
def _author(a: str) -> tuple[str, str] | None:
    """(surname, comparable form) of a name with its type."""
    name, _, kind = a.partition(PART)
    f = names.parse(name, kind or None)
    return f and (f.surname, f.surname + "|" + (",".join(f.givens) if f.kind == "person" else "=" + f.initials))


def author_parts(authors: str | None) -> tuple[tuple[str, ...], str, str]:
    """(surnames, comparable forms, the forms in order)."""
    if not authors:
        return (), "", ""
    if LIST not in authors:
        f = _author(authors)
        return ((f[0],) if f[0] else (), f[1], f[1]) if f else ((), "", "")
    forms = [f for a in authors.split(LIST) if (f := _author(a))]
    told = [f[1] for f in forms]
    return tuple(sorted({f[0] for f in forms if f[0]})), ";".join(told), ";".join(sorted(told))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        flat: list[int] = []
        ends = [0]
        cols = [batch.column(i).to_pylist() for i in (0, *range(2, batch.num_columns))]
        for rid, year, doi, raw, names_, isbns, cont, ab in zip(*cols):
            title, vol, review, cut = title_parts(raw)
            surnames, forms, ordered = author_parts(names_)
            split = title.split()
            # what is left of a word that was broken off says nothing where other words do
            told = [w for w in (split[:-1] if cut and len(split) > 4 else split) if len(w) > 1] or split[:1]
            flat += dict.fromkeys([g for w in told for g in grams(w)])
            ends.append(len(flat))
            isbn = ";".join(sorted({x for x in map(isbn13, isbns.split(LIST)) if x})) if isbns else ""
            container = _folded(cont) if cont else None
            text = "" if title or not ab or placeholder(ab) else " ".join(fold(repair(ab)[0]))
            # rows that say too little to be copies of each other are classes of their own
            alone = "" if (len(split) > 2 or (split and forms)) or (doi and forms) or (forms and (text or isbn)) else str(rid)
            cls = h64(f"{alone}\x1f{title}\x1f{vol}\x1f{review}\x1f{cut}\x1f{year}\x1f{doi or ''}\x1f{ordered}\x1f{container or ''}\x1f{text}\x1f{'' if title else isbn}")
            made.append((cls, title, vol, review, cut, surnames, forms, container, isbn))
        arrays = [pa.array(c, _MADE.field(n).type) for n, c in zip((n for n in _MADE.names if n != "words"), zip(*made) if made else [[]] * (len(_MADE) - 1))]
        arrays.insert(_MADE.get_field_index("words"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], names=[*batch.schema.names[:4], *_MADE.names])


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return _words(strip_marks(text))


#: titles without a letter or digit; only there the text of the abstract is part of what makes rows equal
UNTITLED = "title is null or not rlike(title, '[\\\\p{L}\\\\p{N}]')"
NATURAL_KEYS = "array_distinct(transform(filter(concat(coalesce(sources, array()), array(struct(source, source_id))), s -> s.source is not null and s.source_id is not null), s -> xxhash64(s.source, s.source_id)))"
_AUTHORS = "array_join(transform(filter(authors, a -> a.name is not null), a -> concat(a.name, '\x1f', coalesce(a.type, ''))), '\x1e')"


def normalised(corpus: DataFrame) -> DataFrame:
    """One row of comparable parts per row of ``corpus``."""
    df = corpus.select(
        "record_id", F.expr(NATURAL_KEYS).alias("nat"), "year", F.expr(PLAIN_DOI).alias("doi"), "title", F.expr(_AUTHORS).alias("authors"),
        F.expr("array_join(concat(coalesce(isbn, array()), array(isbn_issn)), '\x1e')").alias("isbn"), "container", F.expr(f"case when {UNTITLED} then abstract end").alias("abstract"),
    )
    return df.mapInArrow(_rows, SCHEMA)
