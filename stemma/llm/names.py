"""Names typed by people, read into comparable parts (plain Python on strings).

``parse`` gives a :class:`Form`: for a person the surname key and all
given parts, each a full name (brought to one form through the nickname and
abbreviation table) or an initial; for an organisation the initials of its words,
the words themselves and the place.

Defined cases: ``None`` and names without a letter give ``None``; a name that can
be read in two orders is read surname-first only when it has a comma, an
upper-case surname, trailing initials or a known given name at its end.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from stemma.llm.encoding import repair
from stemma.llm.visual import canonical

# Given names with their usual short forms and abbreviations.
GIVEN_FORMS = """
alexander: alex alec sasha sascha sandy lex xander alexandre
antonella: tonia nella anto toni antonia
bartholomew: bart barth bartho bat tolly
benedetta: bene detta bened benny
charles: charlie chas chuck karl carl
constance: connie const conny stanze
dmitri: dima mitya dmitry dimitri mitja dim
dolores: lola loli dol lolita dolo
edward: ted ned ed eddie edw eddy
elisabeth: liesl betty elis lisa beth elise lisbeth elizabeth lise eliz els
francesca: franca cesca fran francy franc checca
friedrich: fritz fred friedr frieder fredl
genevieve: vieve ginette gen genev viva ginou
giovanni: gianni nino giov vanni gio
guillermo: memo guille guill willy
harriet: hattie harr harrie hatty
henriette: jette henri henr etta yetta
ignacio: nacho ign iggy igna
johannes: hannes jan joh johann hans
josefina: pepa fina jos josefa pepita josie
katharina: kathi katja kath kathe katrin katharine kat
leopold: leo poldi leop pold
margarete: grete gretl marg gretchen greta margarethe margret rita gretel
nathaniel: nat nate nath nathan
oliver: ollie oli olly noll
philippa: pippa phil pip
quentin: quent quin quint
raphael: rapha raph rafael rafe raf
robert: bob rob robt robbie bert bobby
samuel: sam saml sammy
stanislav: standa slava stan stas stanis
theodora: dora thea theo theod teddy
thomas: tom thos tommy thom
ursula: ulla ursa ursel urs uschi urszula
victoria: vicky tori vic vicki vict viki
wilhelmina: wilma mina wilh minna minnie helmina
william: bill will wm billy willie
xaver: xavi xav xaverl veri
yvonne: vonny yv evi vonnie
zacharias: zach zachar zack zak zachary
"""
# Particles of surnames, titles, role words, and words of organisations.
PARTICLES = {"de", "la", "van", "den", "der", "von", "di", "du", "del", "della", "zu", "le", "da", "dos", "ten", "ter", "des", "d"}
TITLES = {"dr", "prof", "professor", "doctor", "rev", "sir", "mag", "pd", "fr", "mgr"}
ORG_WORDS = ("istitut", "institut", "centre", "center", "academ", "society", "soc.", "seminar", "sem.", "akadem", "ctr", "acad.", "inst.", "ist.", "universit", "gesellschaft", "société", "societ")
ORG_STOP = {"of", "for", "f", "fur", "the", "di", "e", "de", "d", "des", "du", "la", "l", "le", "et", "and", "und", "a", "in", "y", "i", "della", "dell", "fuer"}
ORG_SHORT = {"kg": ("kirchengeschichte",), "ms": ("manuscript",), "mss": ("manuscript",), "hss": ("handschriftenkunde",), "cent": ("centre",), "ctr": ("centre",), "lit": ("literature", "letteratura", "litterature")}
_ORG = re.compile("(?:^| )(?:" + "|".join(map(re.escape, ORG_WORDS)) + ")")
#: the commonest way to write a name: surname, one or two given names or initials
_COMMON = re.compile(r"([A-Za-z]+), ([A-Z][a-z]+|[A-Z]\.)(?: ([A-Z][a-z]+|[A-Z]\.))?")
#: the next common ones, of words that are neither capitals nor initials: the same with accents or abbreviations, and two words or an initial without a comma
_MIXED_CASE, _INITIAL = r"[^\W\d_][a-z][^\W\d_]*", r"[A-ZÀ-ÖØ-Þ]"
_WITH_COMMA = re.compile(rf"({_MIXED_CASE}), ?({_MIXED_CASE}\.?|{_INITIAL}\.)(?: ({_MIXED_CASE}\.?|{_INITIAL}\.))?")
_NO_COMMA = re.compile(rf"({_MIXED_CASE}|{_INITIAL}\.) ({_MIXED_CASE}|{_INITIAL}\.?)")
_NOISE = re.compile(r"[\[(]\s*(?:ed|eds|hg|hrsg|éd|ed\. lit|cur|a cura di|trad|transl|übers)\.?\s*[\])]|,?\s*\(?\b1[5-9]\d\d\s*[-–]\s*(?:\d{4})?\)?\s*$|,?\s*\*\s*\d{4}", re.I)
_BORN = re.compile(r"\b(1[5-9]\d\d)\s*[-–]")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’‐-])*\.?", re.U)


class Form(NamedTuple):
    kind: str  # person | org
    surname: str  # key of the surname; of an organisation its place
    givens: tuple  # full names (longer than a letter) and initials
    born: int | None
    initials: str  # of an organisation's words
    words: tuple  # of an organisation


class _Fold(dict):
    """code point -> folded characters, filled as they occur."""

    def __missing__(self, o: int) -> str:
        v = self[o] = "".join(c for c in unicodedata.normalize("NFKD", chr(o).casefold()) if not unicodedata.combining(c))
        return v


_FOLD = _Fold()


_ODD = re.compile("[^\x00-\x7f]")


def strip_marks(s: str) -> str:
    """Case folded, without accents and compatibility forms."""
    if s.isascii():
        return s.lower()
    odd = set(_ODD.findall(s))
    if len(odd) > 9:
        return s.translate(_FOLD)
    for c in odd:
        v = _FOLD[ord(c)]
        if v != v.lower():  # a sign that stands for capitals stays one
            return s.translate(_FOLD)
        s = s.replace(c, v)
    return s.lower()


_UMLAUT = re.compile("(?<=[aou])e")


@lru_cache(maxsize=50_000)
def surname_key(s: str) -> str:
    """Letters only, without accents; ae, oe and ue count as the plain vowel."""
    k = strip_marks(s)
    if not k.isalpha():
        k = "".join(c for c in k if c.isalpha())
    return _UMLAUT.sub("", k) if "e" in k else k


def _nicknames() -> dict[str, str]:
    out: dict[str, str] = {}
    for line in GIVEN_FORMS.strip().splitlines():
        full, forms = line.split(":")
        out[full] = full
        for f in forms.split():
            if out.setdefault(f, full) != full:
                raise ValueError(f"{f} stands for {out[f]} and {full}")
    return out


NICKNAMES = _nicknames()
_FULL = sorted(set(NICKNAMES.values()))


@lru_cache(maxsize=50_000)
def given_key(token: str) -> str:
    """A full given name, or one letter for an initial."""
    t = strip_marks(token).replace("’", "").replace("'", "")
    dotted = t.endswith(".")
    t = t.strip(".")
    if len(t) == 1:
        return t
    hit = NICKNAMES.get(t)
    if hit:
        return hit
    if dotted or len(t) <= 4:
        full = [n for n in _FULL if n.startswith(t)]
        if len(full) == 1:
            return full[0]
        if dotted:
            return t[0]
    return t


def _is_initials(t: str) -> bool:
    """A, A., A.B., AB (capital letters without small ones, three at most)."""
    bare = t.replace(".", "")
    return 0 < len(bare) <= 3 and bare.isupper() and (len(bare) == 1 or "." in t or len(bare) == 2) and bare.isalpha()


def _split_initials(t: str) -> list[str]:
    return [c.lower() for c in strip_marks(t) if c.isalpha()]


@lru_cache(maxsize=100_000)
def parse(name: str | None, kind: str | None = None) -> Form | None:
    if not name:
        return None
    text = name if name.isascii() and "&" not in name else canonical(repair(name)[0])
    if kind == "corporate" or _ORG.search(text.lower()):
        return _org(text)
    m = _COMMON.fullmatch(text)
    if m and m[1].lower() not in TITLES:
        given = [g for g in m.groups()[1:] if g and g.lower().strip(".") not in TITLES and g.lower() not in PARTICLES]
        return Form("person", surname_key(m[1]), tuple(given_key(g) for g in given), None, "", ())
    f = _two_words(text)
    if f is not None:
        return f
    born = _BORN.search(text)
    text = _NOISE.sub("", text).strip(" ,;/")
    m = _ACRONYM.match(text)
    if m and kind != "person" and "," not in text:
        return _org(text)
    f = _person(text, int(born.group(1)) if born else None)
    return f


def _two_words(text: str) -> Form | None:
    """What :func:`_person` reads in the commonest forms, or None for another form."""
    m = _WITH_COMMA.fullmatch(text)
    if m:
        sur, *giv = m.groups()
        giv = [(g, strip_marks(g)) for g in giv if g]
        if strip_marks(sur) in TITLES:
            return None
        given = [given_key(g) for g, low in giv if low.strip(".") not in TITLES and low not in PARTICLES]
    else:
        m = _NO_COMMA.fullmatch(text)
        if not m:
            return None
        a, b = m.groups()
        low_a, low_b = strip_marks(a), strip_marks(b)
        if low_a in TITLES or low_b in TITLES or low_a in PARTICLES or (low_b in PARTICLES and len(b) > 1):
            return None
        if len(b.strip(".")) == 1:
            if a[-1] == ".":
                return None
            sur, giv = a, b
        else:
            sur, giv = (a, b) if low_b in NICKNAMES and low_a not in NICKNAMES and a[-1] != "." else (b, a)
        given = [given_key(giv)]
    return Form("person", surname_key(sur), tuple(given), None, "", ())


_ACRONYM = re.compile(r"^[^\W\d_a-z]{3,5}\s+[^\W\d_]{5,}$")


def _person(text: str, born: int | None) -> Form | None:
    if "," in text:
        left, _, right = text.partition(",")
        sur = [t for t in _TOKEN.findall(left) if strip_marks(t).strip(".") not in TITLES]
        giv = [t for t in _TOKEN.findall(right.replace(".", ". ")) if strip_marks(t).strip(".") not in TITLES]
        if not sur:
            sur, giv = giv, []
    else:
        spaced = re.sub(r"\.(?=[^\s.])", ". ", text)
        toks = [t for t in _TOKEN.findall(spaced) if strip_marks(t).strip(".") not in TITLES]
        if not toks:
            return None
        if len(toks) == 1:
            sur, giv = toks, []
        else:
            core = [t for t in toks if strip_marks(t) not in PARTICLES or len(t.strip(".")) == 1]
            caps = [t for t in core if len(t) > 3 and t.isupper() and not _is_initials(t)]
            if caps and len(caps) < len(core):
                sur, giv = caps, [t for t in core if t not in caps]
            elif len(core) > 1 and _is_initials(core[-1]):
                cut = next(i for i, t in enumerate(core) if _is_initials(t))
                if cut:
                    sur, giv = core[:cut], core[cut:]
                    if len(sur) > 1 and _known_given(sur[0]):
                        sur, giv = sur[1:], [sur[0], *giv]
                else:
                    sur, giv = core[-1:], core[:-1]
            elif len(core) > 1 and _known_given(core[-1]) and not _known_given(core[0]) and not _is_initials(core[0]):
                sur, giv = core[:1], core[1:]
            elif len(core) > 1 and caps:
                sur, giv = (core[:1], core[1:]) if _known_given(core[-1]) else (core[-1:], core[:-1])
            else:
                sur, giv = core[-1:], core[:-1]
    key = surname_key("".join(t for t in sur if strip_marks(t) not in PARTICLES) or "".join(sur))
    if not key:
        return None
    givens: list[str] = []
    for t in giv:
        if strip_marks(t) in PARTICLES and not _is_initials(t):
            continue
        if _is_initials(t):
            givens += _split_initials(t)
        else:
            for part in re.split("[-‐]", t):
                if part.strip("."):
                    givens.append(given_key(part))
    return Form("person", key, tuple(givens), born, "", ())


def _known_given(t: str) -> bool:
    return strip_marks(t).strip(".") in NICKNAMES


def _org(text: str) -> Form | None:
    text = re.sub(r"[\[(]\s*(?:ed|eds|hg)\.?\s*[\])]", "", text, flags=re.I)
    m = re.search(r"[\[(]([^\])]+)[\])]\s*$", text)
    place, rest = "", text
    if m:
        place, rest = m.group(1), text[: m.start()]
    else:
        parts = [p.strip() for p in re.split(r"[,;]\s+|(?<=[^\W\d_]{5})\.\s+(?=\S+\s)", text) if p.strip()]
        if len(parts) == 2:
            a, b = parts
            first_is_place = len(a.split()) == 1 and len(b.split()) > 1
            place, rest = (a, b) if first_is_place else (b, a)
        else:
            toks = text.split()
            if len(toks) > 1:
                place, rest = toks[-1], " ".join(toks[:-1])
    words = [w for w in re.findall(r"[^\W\d_]+\.?", strip_marks(rest).replace("’", " ").replace("'", " ")) if w.strip(".") not in ORG_STOP]
    head = rest.strip()
    if len(words) == 1 and head.isupper() and len(words[0]) <= 6:
        initials = words[0].strip(".")
        words = []
    else:
        initials = "".join(w[0] for w in words)
    key = surname_key(place)
    if not key and not words:
        return None
    return Form("org", key, (), None, initials, tuple(w.strip(".") for w in words))


# ------------------------------------------------------------------ comparison
def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    if la > lb:
        return a[i + 1 :] == b[i:]
    return a[i:] == b[i + 1 :]


def given_match(a: str, b: str) -> int:
    """2 the same full name, 1 compatible through an initial, 0 different."""
    if len(a) == 1 or len(b) == 1:
        return 1 if a[0] == b[0] else 0
    if a == b:
        return 2
    if len(a) > 4 and len(b) > 4 and near(a, b):
        return 2
    return 0


def givens_match(a: tuple, b: tuple) -> int:
    """3 full first names and no contradiction beyond, 2 full first names with
    one side lacking the rest, 1 initials only, 0 contradictory or nothing known."""
    if not a or not b:
        return 0
    first = given_match(a[0], b[0])
    if not first:
        return 0
    for x, y in zip(a[1:], b[1:]):
        if not given_match(x, y):
            return 0
    if first == 2:
        return 3 if len(a) == len(b) else 2
    return 1


def profile_match(a: tuple, variants: tuple) -> tuple[int, int]:
    """(3, 2, 1 or 0 as in :func:`givens_match`, parts that agree) of given names beside all that a profile holds.

    Each place of the profile holds every name and initial its merged forms have there; one of them must fit.
    """
    if not a or not any(variants):
        return 0, 0
    first = max(given_match(a[0], v[0]) for v in variants if v)
    if not first:
        return 0, 0
    agreed = 1
    for i, x in enumerate(a[1:], 1):
        known = [v[i] for v in variants if len(v) > i]
        if known:
            if not any(given_match(x, y) for y in known):
                return 0, 0
            agreed += 1
    if first == 2:
        return (3 if any(len(v) == len(a) for v in variants) else 2), agreed
    return 1, agreed


def org_match(words: tuple, initials: str, other: tuple, other_initials: str) -> bool:
    """Do the words (possibly shortened), or the acronym, stand for the other name?"""
    if not words:
        return initials == other_initials or _kg(other) == initials or _elided(other) == initials
    i = 0
    hits = 0
    for w in words:
        ok = False
        for j in range(i, len(other)):
            o = other[j]
            if o.startswith(w) or near(w, o) or o in ORG_SHORT.get(w, ()) or (len(w) > 6 and len(o) > 6 and near(w[:7], o[:7])):
                i, ok = j + 1, True
                break
        hits += ok
    return hits >= max(1, len(words) - 1) and hits * 2 >= len(other)


def _kg(words: tuple) -> str:
    return "".join("kg" if w == "kirchengeschichte" else "ms" if w == "manuscript" else w[0] for w in words)


def _elided(words: tuple) -> str:
    return "".join(w[0] for w in words)
