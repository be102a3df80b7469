"""Visually identical text with different characters: one consistent form.

A table is compiled once from the Unicode database and from a short look-alike
table, checked for conflicts, and then applied by a longest-match transducer
that reads a text once, grapheme cluster by grapheme cluster (a base with the
marks that follow it).  Widths, ligatures, compatibility letters, spaces,
invisible characters and accents are looked up in the table; a letter of another
script is replaced by the letter that it imitates when the word around it (or,
for an initial, the field) is written in one script otherwise.

Defined cases: ``None`` stays ``None``; an empty text stays empty; typographic
quotes, dashes and ellipses, ordinal and superscript signs, whole words in their
own script, and stretches for which ``skip`` returns true (garbled text) are left
as they are.  There is no limit on the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import chain

# Letters of one shape in Latin, Cyrillic and Greek ("" where the
# script has none that looks alike).
LOOK_ALIKES = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", ""),
    ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"),
    ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", "", "Ζ"), ("a", "а", "α"), ("c", "с", "ϲ"), ("d", "ԁ", ""), ("e", "е", ""),
    ("h", "һ", ""), ("i", "і", "ι"), ("j", "ј", ""), ("k", "к", "κ"), ("o", "о", "ο"), ("p", "р", "ρ"), ("q", "ԛ", ""),
    ("s", "ѕ", ""), ("u", "", "υ"), ("v", "ѵ", "ν"), ("w", "ԝ", ""), ("x", "х", "χ"), ("y", "у", "γ"), ("ï", "ї", "ϊ"),
)
SCRIPTS = ("L", "C", "G")
# Signs that have a compatibility form but are ordinary typography.
TYPOGRAPHY = set("ªº²³¹´¨¯¸…‥‗№™℠″‴‼⁇⁈⁉½¼¾µ·")
_KEPT_TAGS = {"<super>", "<sub>", "<fraction>"}


class ConflictError(ValueError):
    """Two rules give one cluster different forms, or a form isn't stable."""


class _Scripts(dict):
    """letter -> its script, filled as they occur."""

    def __missing__(self, c: str) -> str:
        v = self[c] = _script(c)
        return v


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x1E00 <= o < 0x1F00:
        return "L"
    return "O" if c.isalpha() else ""


script = _Scripts().__getitem__


def compile_table(rules: list[tuple[str, str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """cluster -> (form, kind) from the Unicode database plus ``rules``; raises ConflictError."""
    table: dict[str, tuple[str, str]] = {}

    def put(key: str, form: str, kind: str) -> None:
        old = table.get(key)
        if old is not None and old[0] != form:
            raise ConflictError(f"{key!r}: {old[0]!r} and {form!r}")
        table[key] = (form, kind)

    # everything but ideographs, syllables of Hangul, private use and the planes without letters that have such forms
    for o in chain(range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0x1EE00, 0x1EF00), range(0x1F100, 0x1F200), range(0xE0000, 0xE0080)):
        c = chr(o)
        cat = unicodedata.category(c)
        if cat == "Zs":
            put(c, " ", "space")
        elif cat == "Cf":
            put(c, "", "invisible")
        elif cat[0] in "LNPSM" and c not in TYPOGRAPHY:
            d = unicodedata.decomposition(c)
            if not d:
                continue
            if d[0] == "<":
                if d.split()[0] in _KEPT_TAGS:
                    continue
                form = unicodedata.normalize("NFKC", c)
                if form != c and not form.startswith(" ") and cat[0] in "LNP":
                    put(c, form, "width")
                elif form != c and d.startswith(("<wide>", "<narrow>")):
                    put(c, form, "width")
            else:
                form = unicodedata.normalize("NFC", c)
                if form != c:
                    put(c, form, "accent")
                elif len(d.split()) == 2 and unicodedata.combining(chr(int(d.split()[1], 16))):
                    put(unicodedata.normalize("NFD", c), c, "accent")
                    put(chr(int(d.split()[0], 16)) + chr(int(d.split()[1], 16)), c, "accent")
    for key, form, kind in rules or ():
        put(key, form, kind)
    for key, (form, _) in table.items():
        again = "".join(table.get(c, (c, ""))[0] for c in form)
        if again != form:
            raise ConflictError(f"{key!r} gives {form!r}, which isn't stable")
    return table


def compile_look_alikes(rows=LOOK_ALIKES) -> dict[tuple[str, str], str]:
    """(letter, script wanted) -> letter; raises ConflictError."""
    out: dict[tuple[str, str], str] = {}
    for row in rows:
        for have in row:
            for want, letter in zip(SCRIPTS, row):
                if have and letter and have != letter:
                    if out.setdefault((have, want), letter) != letter:
                        raise ConflictError(f"{have!r} in {want}")
    return out


_TABLE = compile_table()
_ALIKE = compile_look_alikes()
_MARK = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
_CLUSTER = re.compile(f"[^{_MARK}][{_MARK}]*|[{_MARK}]+", re.S)
#: characters that can take part in a case whatever stands beside them
_ODD = frozenset([k for k in _TABLE if len(k) == 1] + [chr(o) for lo, hi in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)) for o in range(lo, hi)])
_PLAIN_WORD = re.compile("[A-Za-z]{2,}")
_OTHER_SCRIPT = re.compile("[\u0370-\u04ff]")
#: two scripts in one word, or a lone letter of another script
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z\u00c0-\u024f]|[\u0370-\u03ff][\u0400-\u04ff]|[\u0400-\u04ff][\u0370-\u03ff]|(?<![^\\W\\d_])[\u0370-\u04ff]\\.")


def _worth(text: str) -> bool:
    return not _ODD.isdisjoint(text) or (_OTHER_SCRIPT.search(text) is not None and _MIXED.search(text) is not None)




class Transducer:
    """Applies the compiled table in one pass; :meth:`form` gives (text, kinds of change)."""

    def __init__(self, table=None, alike=None):
        self.table = _TABLE if table is None else table
        self.alike = _ALIKE if alike is None else alike
        self._clusters: dict[str, tuple[str, str]] = {}

    def _cluster(self, g: str) -> tuple[str, str]:
        """The form of one cluster: the longest key of the table first, the rest composed."""
        hit = self._clusters.get(g)
        if hit is None:
            form, kind = g, ""
            if g in self.table:
                form, kind = self.table[g]
            elif len(g) == 1:
                pass
            else:
                head, hk = self.table.get(g[0], (g[0], ""))
                form = unicodedata.normalize("NFC", head + g[1:])
                kind = hk or ("accent" if form != g else "")
            if len(self._clusters) < 200_000:
                self._clusters[g] = (form, kind)
            hit = (form, kind)
        return hit

    def form(self, text: str | None, skip: Callable[[str], bool] | None = None) -> tuple[str | None, frozenset]:
        if not text or text.isascii() or not _worth(text):
            return text, frozenset()
        out: list[str] = []
        word: list[str] = []
        kinds: set[str] = set()
        home = ""
        pending: list[int] = []  # places of lone letters, settled by the script of the field
        counts = {"L": 0, "C": 0, "G": 0}

        def close(after: str) -> None:
            if not word:
                return
            w = "".join(word)
            if not w.isascii():
                seen = {s for c in w if (s := script(c))}
                if len(seen) > 1:
                    w2 = self._one_script(w, seen, counts)
                    if w2 != w:
                        kinds.add("look-alike")
                        w = w2
                elif len(w) == 1 and seen:
                    pending.append(len(out))
            if len(w) > 1:
                s = script(w[0]) or script(w[-1])
                if s in counts:
                    counts[s] += len(w)
            out.append(w)
            word.clear()

        for chunk in re.split(r"([ \t\r\n]+)", text):
            if skip is not None and chunk and not chunk.isascii() and skip(chunk):
                close("")
                out.append(chunk)
                continue
            if chunk.isascii():
                # nothing to look up: a word of plain letters only tells the script of the field
                close("")
                counts["L"] += sum(map(len, _PLAIN_WORD.findall(chunk)))
                out.append(chunk)
                continue
            for m in _CLUSTER.finditer(chunk):
                g = m.group()
                if g < "\x80" and len(g) == 1:
                    f, k = g, ""
                else:
                    f, k = self._cluster(g)
                    if k:
                        kinds.add(k)
                if f < "\x80" and len(f) == 1:
                    if f.isalpha():
                        word.append(f)
                    else:
                        close(f)
                        out.append(f)
                    continue
                for c in f:
                    if script(c):
                        word.append(c)
                    elif word and unicodedata.combining(c):
                        word.append(c)
                    else:
                        close(c)
                        out.append(c)
        close("")
        home = max(counts, key=counts.get)
        if pending and counts[home]:
            for i in pending:
                s = script(out[i])
                to = self.alike.get((out[i], home))
                initial = i + 1 < len(out) and out[i + 1] == "."
                if s != home and to and initial and counts[s if s in counts else "L"] * 4 < counts[home]:
                    out[i] = to
                    kinds.add("look-alike")
        return ("".join(out) if kinds else text), frozenset(kinds)

    def _one_script(self, word: str, seen: set[str], counts: dict[str, int]) -> str:
        """The word in the one script that all its letters can take, else unchanged."""
        options = []
        for want in SCRIPTS:
            if want in seen:
                own = [c for c in word if script(c) == want]
                rest = [c for c in word if script(c) and script(c) != want]
                if rest and all((c, want) in self.alike for c in rest):
                    sure = sum(not any((c, o) in self.alike for o in SCRIPTS if o != want) for c in own)
                    options.append((sure > 0, counts.get(want, 0) > 0, len(own), want))
        if not options:
            return word
        want = max(options)[3]
        return "".join(c if script(c) in ("", want) else self.alike[c, want] for c in word)


TRANSDUCER = Transducer()


def canonical(text: str | None) -> str | None:
    """The consistent form of a text."""
    return TRANSDUCER.form(text)[0]
