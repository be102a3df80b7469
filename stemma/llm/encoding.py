"""Garbled text from a wrong character encoding: detection and restoration.

A piece of text is a node of a graph whose edges are *encode with A, decode
with B* and *unescape*.  A best-first search with a visited set walks that
graph from the delivered text; a character-plausibility cost guides it, and the
cheapest text reached is the restoration.  Costs alone bound the search: no step is
taken that cannot lead below the best cost, nor a detour dearer than stated.  The search runs on blank-separated
words, because only a part of a field may be garbled; the chain found for one
word is tried first on the next suspicious word of the same field.

Everything here is plain Python on strings so that Spark can call it inside an
Arrow-batched ``mapInPandas``; :mod:`stemma.llm.p5_encoding` does that.

Defined cases: ``None`` and texts without any suspicious character come back
unchanged and not garbled; a replacement character U+FFFD makes a text garbled
but not restorable; there is no limit on the length of a text.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import OrderedDict

from stemma.llm.visual import TRANSDUCER

REPLACEMENT = "�"

# The single-byte encodings the search can encode to, the
# decodings tried after each, and the cost figures of the plausibility model.
ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8-r", "cp1253", "iso8859-7")
SINGLE_BYTE_STEPS = {
    "cp1252": ("cp1251", "cp1253", "mac_roman", "koi8-r", "cp1250", "cp437"),
    "latin-1": ("cp1251", "cp1253", "mac_roman", "koi8-r"),
    "mac_roman": ("cp1252", "cp1251", "cp1253"),
    "cp437": ("cp1252", "cp1251", "cp1253"),
    "cp850": ("cp1252",),
    "cp1250": ("cp1252",),
    "cp1251": ("cp1252", "koi8-r", "cp866", "cp1253"),
    "cp866": ("cp1251", "cp1252"),
    "koi8-r": ("cp1251", "cp866"),
    "cp1253": ("cp1252", "cp1251"),
    "iso8859-7": ("cp1252",),
}
STEP_COST = 0.35
MIN_GAIN = 1.5
#: a text may cost this much more than the delivered one on the way to a cheaper one, less for every step taken
DETOUR, DETOUR_STEP = 2.0, 0.9


def _byte_table(name: str) -> dict[str, int]:
    """char -> byte; bytes an encoding leaves undefined count as C1 controls."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


_TO_BYTE = {name: _byte_table(name) for name in ENCODINGS}
_FROM_BYTE = {name: {b: c for c, b in t.items()} for name, t in _TO_BYTE.items()}
_TRANS = {name: str.maketrans({chr(b): c for b, c in t.items()}) for name, t in _FROM_BYTE.items()}


def _encode(text: str, name: str) -> bytes | None:
    table = _TO_BYTE[name]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


# ---------------------------------------------------------------- plausibility
_ORDINARY_PUNCT = set("’“”–—…«»‘‒‑")
_INVISIBLE = set("​‌‍‎‏⁠﻿\xad\xa0   　")
# Latin letters beyond Latin-1 that the languages of such records use.
_USUAL_EXTENDED = set("āēīōūĀĒĪŌŪšžŠŽčČœŒřěŸ")
# Signs that plain text uses on their own.
_SIGNS = set("£§¶±€½¼¾†¹²³√©®°¢¥¤×÷·№™µ¬")
# Russian and Greek letters by how common they are.
_RUSSIAN_COMMON = set("оеаинтсрвлкмдпу")
_RUSSIAN_OTHER = set("яыьгзбчйхжш")
_RUSSIAN_RARE = set("юцщэфъё")
_GREEK_COMMON = set("αοιεηστνυρπκμλςάόίέήύωάέ")


def _char_class(c: str) -> tuple[str, float]:
    """(class, cost). Classes: a ascii letter, l/u Latin accented lower/upper, g Greek, c Cyrillic, o other letter, d digit, p punctuation, s symbol, x control, m mark."""
    o = ord(c)
    if o < 128:
        if c.isalpha():
            return ("a" if c.islower() else "A"), 0.0
        return ("d" if c.isdigit() else "p"), 0.0
    if c in _INVISIBLE:
        return "i", 0.8 if c in "\xad\xa0" else 0.0
    if c in _ORDINARY_PUNCT:
        return "q", 0.1
    if o < 0xA0:
        return "x", 4.0
    if 0xFF00 <= o < 0xFFF0:
        return "p", 0.0
    cat = unicodedata.category(c)
    if cat[0] == "L":
        if o < 0x250:
            if o in (0xAA, 0xBA):
                return "p", 0.4
            if c in "ðþÐÞÆæ":
                return ("l" if c.islower() else "u"), 1.0
            base = 0.3 if o < 0x100 else 0.6 if c in _USUAL_EXTENDED else 1.9
            return ("l" if c.islower() else "u"), base + (0.3 if c.isupper() else 0)
        if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            return ("g" if c.islower() else "G"), 1.2 if c in "ΰϋϊΫΪ" else 0.1 if c.lower() in _GREEK_COMMON else 0.3
        if 0x400 <= o < 0x530:
            low = c.lower()
            return ("c" if c == low else "C"), 0.1 if low in _RUSSIAN_COMMON else 0.3 if low in _RUSSIAN_OTHER else 0.7 if low in _RUSSIAN_RARE else 0.9
        return "o", 0.5
    if cat[0] == "M":
        return "m", 0.9
    if c == "†" or c == "§" or c == "¶":
        return "s", 1.0
    if c in "„¿¡°²³¹№·":
        return "p", 0.4
    return "s", 1.6


_CLASS: dict[str, tuple[str, float]] = {}


def _cls(c: str) -> tuple[str, float]:
    v = _CLASS.get(c)
    if v is None:
        v = _CLASS[c] = _char_class(c)
    return v


def cost(text: str) -> float:
    """How implausible a word is as written text; 0 for ASCII words."""
    if text.isascii():
        return 0.4 * len(_ENTITY.findall(text)) * 5 if "&" in text else 0.0
    total, prev, prevc, before = 0.0, " ", " ", " "
    letters = "aAlugGcCo"
    for c in text:
        k, v = _cls(c)
        total += v
        if prev not in letters and c in "ьъыЬЪЫ":
            total += 1.0
        if prev == "q" and k in letters and before in letters and prevc not in "’‑":
            total += 0.6 if prevc in "‘–—" else 2.0
        if k in letters and prev in letters:
            latin, was = k in "aAlu", prev in "aAlu"
            if latin != was or (not latin and k.lower() != prev.lower()):
                total += 2.0
            elif k == "u" and prev in "al":
                total += 2.0
            elif (k == "C" and prev == "c") or (k == "G" and prev == "g"):
                total += 2.2
            elif k in "lu" and prev in "lu":
                total += 0.9
            elif k == "A" and prev == "l":
                total += 0.4
            elif k == "a" and prev == "u" and prevc in "ÃÂÐÑÎÏ":
                total += 0.6
        elif (k == "s" and prev in letters) or (k in letters and prev == "s"):
            total += 1.6
        elif k == "s" and prev in "suqp" and prev != "p":
            total += 1.0
        elif k == "p" and v and prev in letters:
            total += 1.2
        elif k in "aAlu" and prev == "p" and prevc in "„·³²¹°":
            total += 1.5 if prevc != "„" else 0.0
        elif k == "q" and prev == "u":
            total += 0.8
        elif k == "q" and c in "“”«»–‘…" and prev in "lu":
            total += 0.4
        elif k in letters and prev == "q" and prevc in "”…":
            total += 1.0
        before, prev, prevc = prev, k, c
    return total


_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[a-zA-Z]{2,8}\d?);")

# A word is worth searching when it holds a character that plain text seldom
# has, an accented capital after a small letter, two scripts, or a run of
# accented letters.
_ODD_SIGNS = (
    "\x80-\x9f¢-©¬®-¹¼-¾×÷"
    "ÂÃÄÅÆÐÑÞðþƒˆ-˝"
    "Ă-ąĆ-ċĎ-đĔ-ęĜ-ĩĬ-ŋŎ-őŔ-ŗŘŚ-şŢ-ũŬ-żΰϋϊ"
    "‚†-•‰‹›₧€№™Ω∀-⏿─-◿"
    "Ђ-Џђ-џҐґ"
)
_SUSPICIOUS = re.compile(
    "[" + _ODD_SIGNS + "]"
    "|(?<=[a-zäöü])\ufb02(?=e[nrsm]?\\b|t\\b|\\W|$)|[a-zß-öø-ÿ][À-ÖØ-Þ]|[A-Za-zÀ-ÿ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ÿ]"
    "|[ß-öø-ÿÀ-ÖØ-Þ]{3}|[а-яё][А-ЯЁ]|" + _ENTITY.pattern
)
#: the same, told at the first character beyond ASCII that takes part, so that plain letters are passed over at once
_SUSPICIOUS_SIGN = re.compile(
    "[\x80-\U0010ffff](?:(?<=[" + _ODD_SIGNS + "])"
    "|(?<=[a-zäöü]\ufb02)(?=e[nrsm]?\\b|t\\b|\\W|$)|(?<=[a-zß-öø-ÿ][À-ÖØ-Þ])|(?<=[A-Za-zÀ-ÿ][Ͱ-ӿ])|(?<=[Ͱ-ӿ])(?=[A-Za-zÀ-ÿ])"
    "|(?<=[ß-öø-ÿÀ-ÖØ-Þ])(?=[ß-öø-ÿÀ-ÖØ-Þ]{2})|(?<=[а-яё][А-ЯЁ]))"
)


def _suspicious(text: str) -> bool:
    """Does ``_SUSPICIOUS`` occur in the text?"""
    return _SUSPICIOUS_SIGN.search(text) is not None or ("&" in text and _ENTITY.search(text) is not None)


_ORDINAL = re.compile(r"^\d+™$")  # the ordinal sign read in another single-byte encoding
_WEAK_ALONE = re.compile(r"^[\W\d_]*\w?[\W\d_]*$")
# spacing and invisible characters belong to another problem; the search ignores them at word ends
_MIXED = re.compile("[A-Za-zÀ-ɏ][^\\s]*[Ͱ-ӿ]|[Ͱ-ӿ][^\\s]*[A-Za-zÀ-ɏ]|[Ͱ-Ͽ][^\\s]*[Ѐ-ӿ]|[Ѐ-ӿ][^\\s]*[Ͱ-Ͽ]|[！-￯]")
_STRIP = "​‌‍‎⁠﻿"


def _search(word: str) -> tuple[str, tuple, float]:
    """Best-first search; returns (cheapest text, chain of steps, gain)."""
    start = cost(word)
    best, best_cost, best_chain = word, start, ()
    heap = [(start, 0, word, ())]
    seen = {word}
    while heap:
        _, depth, text, chain = heapq.heappop(heap)
        spent = STEP_COST * (depth + 1)
        if spent >= best_cost:
            continue  # no text behind one more step can be cheaper than the best
        for step, new in _neighbours(text):
            if new in seen:
                continue
            seen.add(new)
            total = cost(new) + spent
            if total < best_cost - 1e-9:
                best, best_cost, best_chain = new, total, (*chain, step)
            if total < start + DETOUR - DETOUR_STEP * depth:
                heapq.heappush(heap, (total, depth + 1, new, (*chain, step)))
        if best_cost <= STEP_COST * 2:
            break
    return best, best_chain, start - best_cost


def _neighbours(text: str):
    if "&" in text:
        new = html.unescape(text)
        if new != text:
            yield ("unescape", ""), new
    for name in ENCODINGS:
        raw = _encode(text, name)
        if raw is None:
            continue
        try:
            new = raw.decode("utf-8")
            if new != text and len(new) < len(text):
                yield (name, "utf-8"), new
        except UnicodeDecodeError:
            pass
        latin = raw.decode("latin-1")
        for dec in SINGLE_BYTE_STEPS[name]:
            new = latin.translate(_TRANS[dec])
            if new != text:
                yield (name, dec), new


def apply_chain(text: str, chain: tuple) -> str | None:
    """The text after the steps of a chain, or None where a step can't be taken."""
    for name, dec in chain:
        if name == "unescape":
            text = html.unescape(text)
            continue
        raw = _encode(text, name)
        if raw is None:
            return None
        if dec == "utf-8":
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            text = raw.decode("latin-1").translate(_TRANS[dec])
    return text


class _Memo(OrderedDict):
    """Bounded memory of searched words; only speed depends on its size."""

    def __init__(self, size: int = 50_000):
        super().__init__()
        self.size = size

    def find(self, word: str):
        hit = self.get(word)
        if hit is None:
            hit = self[word] = _search(word)
            if len(self) > self.size:
                self.popitem(last=False)
        return hit


_memo = _Memo()
_SPLIT = re.compile(r"([ \t\r\n   　]+)")


def repair(text: str | None, words: set | None = None) -> tuple[str | None, bool, bool]:
    """(text as restored, garbled?, wholly restored?); ``words`` gets the garbled words."""
    if not text or (text.isascii() and "&" not in text):
        return text, False, True
    lost = REPLACEMENT in text
    if not _suspicious(text):
        return text, lost, not lost
    parts = _SPLIT.split(text)
    before = list(parts)
    chains: dict[tuple, float] = {}
    weak, garbled = [], False
    for i in range(0, len(parts), 2):
        w = parts[i]
        if not w or (w.isascii() and "&" not in w) or REPLACEMENT in w or not _suspicious(w):
            continue
        core = w.strip(_STRIP)
        if _MIXED.search(core):
            plain = TRANSDUCER.form(core)[0]
            if not _suspicious(plain):
                continue
        new = None
        for chain in sorted(chains, key=chains.get, reverse=True)[:2]:
            got = apply_chain(core, chain)
            if got is not None and cost(core) - cost(got) - STEP_COST * len(chain) >= 0.4:
                new = got
                break
        if new is None:
            got, chain, gain = _memo.find(core)
            if not chain or gain < 0.4:
                continue
            if gain < MIN_GAIN or _WEAK_ALONE.match(core):
                weak.append((i, w, core, got, chain, gain))
                continue
            new = got
            chains[chain] = chains.get(chain, 0.0) + gain
        garbled = True
        parts[i] = w.replace(core, new)
    if weak:
        if not garbled:
            garbled = _weak_alone(parts, weak)
        else:
            top = max(chains, key=chains.get) if chains else ()
            for i, w, core, got, chain, gain in weak:
                via = apply_chain(core, top) if top else None
                if via is not None and via != core:
                    parts[i] = w.replace(core, via)
                elif gain >= 1.0:
                    parts[i] = w.replace(core, got)
    if garbled and chains:
        # words that look harmless on their own but stand inside a garbled run
        top = max(chains, key=chains.get)
        slack = 0.5 if top[0][1] == "utf-8" else 0.0 if top[0][1] in ("cp1251", "cp1253", "koi8-r") else None
        if slack is not None:
            for i in range(0, len(parts), 2):
                w = parts[i]
                if w and not w.isascii() and w == before[i]:
                    via = apply_chain(w, top)
                    if via is not None and via != w and cost(via) < cost(w) + slack:
                        parts[i] = via
        else:
            # another script inside a word that the same step explains
            for i in range(0, len(parts), 2):
                w = parts[i]
                if w == before[i] and _MIXED.search(w):
                    via = apply_chain(w, top)
                    if via is not None and cost(via) < cost(w) - 1.0:
                        parts[i] = via
    if words is not None:
        words.update(b for a, b in zip(parts, before) if a != b or REPLACEMENT in b)
    return "".join(parts), garbled or lost, not lost


def _weak_alone(parts: list[str], weak: list) -> bool:
    """Fields whose only odd words are single characters: a lone sign that one
    step turns into a one-letter word counts; quoted or listed signs do not."""
    found = False
    for i, w, core, got, chain, gain in weak:
        letters = [c for c in got if c.isalpha()]
        signs = [c for c in core if not c.isascii()]
        if not signs or gain < 0.8:
            continue
        if chain == (("cp1250", "cp1252"),) or core == "Ë" or _ORDINAL.match(core):
            # letters none of these languages writes, each the neighbour of a common one
            parts[i] = w.replace(core, got)
            found = True
            continue
        if all(c in _SIGNS for c in signs):
            continue
        if len(letters) == 1 and letters[0] in "àáéèíìóòúùâêôyoeа" and len(got) <= 2 and not any(c.isalpha() for c in core):
            parts[i] = w.replace(core, got)
            found = True
        elif len(signs) >= 2 and len(got) < len(core) and "’" not in core and "‘" not in core:
            parts[i] = w.replace(core, got)
            found = True
    return found
