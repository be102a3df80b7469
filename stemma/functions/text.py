"""Text normalisers as columns: they stay inside whole-stage code generation.

Every function takes a column and gives a column.  Defined cases: null stays null,
an empty text stays empty unless said otherwise, length is not limited.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold_alphabet() -> tuple[str, str]:
    """(accented letters, their base letters): letters whose decomposition is one small base letter and marks."""
    src, dst = [], []
    for o in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x400, 0x460), *range(0x1E00, 0x2000)]:
        c = chr(o)
        if not c.isalpha() or c != c.lower():
            continue
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c:
            src.append(c)
            dst.append(base[0].lower())
    return "".join(src) + "ς", "".join(dst) + "σ"


FOLD_FROM, FOLD_TO = fold_alphabet()
MARKS = "[\\u0300-\\u036f]"
_MARKS_PLAIN = "[̀-ͯ]"


def fold(c: Column) -> Column:
    """Lower case without accents (Latin, Greek, Cyrillic)."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), MARKS, "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    """Folded words of any script, one blank between them."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def fold_title(c: Column) -> Column:
    """Folded Latin words: other signs count as blanks."""
    return F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))


def norm_key(c: Column) -> Column:
    """Folded, blanks squeezed, outer punctuation dropped."""
    return F.regexp_replace(squeeze(fold(c)), r"^[.,;: ]+|[.,;: ]+$", "")


def slug(c: Column) -> Column:
    """Letters and digits of any script joined by '-'; a hash where none is left."""
    s = F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.concat(F.lit("x-"), F.substring(F.sha1(c), 1, 8))).otherwise(s)


def truncate(c: Column, n: int = 120) -> Column:
    """At most n characters and an ellipsis, without trailing punctuation."""
    cut = F.regexp_replace(F.substring(c, 1, n), r"[\s.,;:]+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


# Stop words of five languages in search.
SEARCH_STOP = (
    "the and for with from that this was are its our not but all any how who "
    "des les une dans pour sur avec par aux ses est comme entre chez "
    "der die das und von den dem ein eine des mit auf ist als bei aus "
    "che del della dei con per una nel nella sul "
    "los las una del por con para sobre entre"
).split()


def tokens(c: Column) -> Column:
    """Search tokens: Latin words of three characters or more that are no stop words; repeats stay."""
    parts = F.split(F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), MARKS, ""), "[^0-9a-z']+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(*SEARCH_STOP))


def strip_tags(c: Column) -> Column:
    """Markup dropped, the common entities resolved, blanks squeezed; null when nothing is left."""
    t = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = squeeze(t)
    return F.when(t == "", None).otherwise(t)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All entities resolved; for texts with others than the common ones."""
    return s.map(lambda t: html.unescape(t) if t and "&" in t else t)


@F.pandas_udf(StringType())
def casefold_nfkd(s: pd.Series) -> pd.Series:
    """Full case folding and NFKD without marks, where the translation table does not reach (ß, ligatures)."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if t.isascii():
            return t.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))

    return s.map(one)


def inverted_to_text(c: Column) -> Column:
    """map<word, array<position>> to text: words in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


# Marker words of a language by weight (elided forms end in a backtick).
LANGUAGE_WORDS = {
    "it": {
        3: "della dello degli delle nella nello negli nelle sulla sullo dalla dalle allo agli alla",
        2: "di nel nei dal dai gli che come secondo studi ricerche tra fra questione storia pensiero padri scuola chiesa vita cultura opere lettera commento problema rapporto figura testo libro antico antica nuovo nuova primo greco cristiana cristiano ancora anche dopo contro",
        1: "il lo una un per non con suo sua alcuni nella nel sui sul",
    },
    "fr": {
        3: "dans selon chez aux entre étude études autour ainsi celui leur ses cette quelques",
        2: "père pères église vie oeuvre lettre commentaire pensée problème figure thème texte livre ancien nouveau premier grec chrétienne chrétien des une du sur pour et par est ou au à son ancienne nouvelle autour depuis jusqu encore même aussi contre avant après face",
        1: "la le les de en se ce qui que ne",
    },
    "de": {
        3: "die der das den dem und zur zum über bei für eines einer einem nach zwischen durch seine ihre als nicht sich zwei untersuchungen studien beiträge beitrag geschichte frage bemerkungen anmerkungen auslegung deutung verhältnis",
        2: "von im des ein eine auf aus mit vom am zu",
    },
    "en": {
        3: "the and of to for from between according with its his her their some early new this about towards through against",
        2: "studies essays study notes remarks reading interpretation thought problem question",
        1: "in on a an as by is are was were",
    },
    "es": {3: "el los las según españa papel hacia sobre entre desde una del para escuela teología filosofía pensamiento estudios", 1: "y en que su no"},
    "nl": {3: "het van een door zijn niet bij over naar uitleg receptie christelijke joodse tussen deze", 1: "de en in te op"},
    "la": {3: "apud liber libri opera omnia secundum atque quaestiones commentarii editio epistulae fragmenta adversus hominis", 1: "de in ad contra super et ex cum"},
}
# Markers that are no single words, by language and weight, and whether they begin a word: elisions and one pair.
LANGUAGE_SIGNS = (
    ("it", 3, False, r"(?:dell|nell|all|sull|dall|quell|un|nel)`"),
    ("it", 1, True, r"(?:l|d)`[aeiouàèéìòù]"),
    ("fr", 3, True, r"(?:qu|j|c|s|n|m|t)`[a-zàâçéèêëîïôûùüÿœ]"),
    ("fr", 1, True, r"(?:l|d)`[a-zàâçéèêëîïôûùüÿœ]"),
    ("es", 1, True, r"de la\b"),
)
LANGUAGES = tuple(LANGUAGE_WORDS)
_RUN_OF_LETTERS = re.compile(r"\w+")


def _marker_weights() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for i, lists in enumerate(LANGUAGE_WORDS.values()):
        for weight, words in lists.items():
            for w in words.split():
                out.setdefault(w, []).append((i, weight))
    return out


_MARKERS = _marker_weights()
_SIGNS = [(LANGUAGES.index(k), w, re.compile((r"\b" if begins else "") + p), "`" if "`" in p else "de la") for k, w, begins, p in LANGUAGE_SIGNS]


@F.pandas_udf(StringType())
def _language(texts: pd.Series, min_score: pd.Series, margin: pd.Series) -> pd.Series:
    least, lead = (int(min_score.iloc[0]), int(margin.iloc[0])) if len(texts) else (0, 0)

    def one(t: str | None) -> str | None:
        t = t.strip().lower() if t else ""
        if len(t) < 12 or len(t.split()) < 3:
            return None
        score = [0] * len(LANGUAGES)
        for w, n in Counter(_RUN_OF_LETTERS.findall(t)).items():
            for i, weight in _MARKERS.get(w, ()):
                score[i] += n * weight
        for i, weight, pattern, sign in _SIGNS:
            if sign in t:
                score[i] += weight * len(pattern.findall(t))
        best, second = sorted(score, reverse=True)[:2]
        return LANGUAGES[score.index(best)] if best >= least and best - second >= lead else None

    return texts.map(one)


def guess_language(c: Column, min_score: int = 3, margin: int = 2) -> Column:
    """The language whose marker words weigh most, if they weigh enough and lead by a margin; else null.

    The words of a text are counted once and looked up; texts under 12 characters or three words have none.
    """
    return _language(c, F.lit(min_score), F.lit(margin))


#: ordered repairs of card-catalogue text: pattern, replacement
CATALOGUE_REPAIRS = (
    ("zero_for_blank", r"(?<=[\p{Ll}])\.0(?=\p{Lu})", ". "),
    ("year_range", r"\((1[0-9]{2})\?([0-9]{3})/[0-9]{2}\)", "$1–$2"),
    ("double_blank", r" {2,}", " "),
    ("blank_before_comma", r" +,", ","),
)


def catalogue_repairs(c: Column) -> Column:
    """struct(text, array of the rules that fired)."""
    text, fired = c, []
    for name, pattern, to in CATALOGUE_REPAIRS:
        fired.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, to)
    return F.struct(text.alias("text"), F.array_compact(F.array(*fired)).alias("rules"))
