"""Problems on characters and encodings: plain Python parts and small tables."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemma.llm import p2_visual, p5_encoding
from stemma.llm.encoding import repair
from stemma.llm.visual import TRANSDUCER, ConflictError, canonical, compile_look_alikes, compile_table

CORPUS = "record_id bigint, title string, authors array<struct<name:string,role:string,type:string,gnd:string>>, abstract string, extra string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｔｈｅ　library", "The library"), ("café", "café"), ("a​b­c﻿", "abc"), ("Studien zu", "Studien zu"), ("librarу of Νeradion", "library of Neradion"), ("ﬁne", "fine"), ("А. Ingman", "A. Ingman"),
        ("Συμβολή στηv έρευνα", "Συμβολή στην έρευνα"), ("‏", ""), ("Ⅷ", "VIII"),
    ],
)
def test_forms(text, want):
    form, kinds = TRANSDUCER.form(text)
    assert form == want and kinds
    assert TRANSDUCER.form(form) == (form, frozenset())


@pytest.mark.parametrize("text", ["", "plain", "“quoted” – and… 2ª parte, n.º 3, fol. 12ᵛ", "λόγος", "Школа и жизнь", "(s̱alāt)".replace("ā", "ā"), "From (Ω) to λόγος", "Mc Donald’s", None])
def test_no_cases(text):
    assert TRANSDUCER.form(text) == (text, frozenset())


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_form_is_stable_and_nfc_keeps(text):
    form = canonical(text)
    assert canonical(form) == form
    assert not any(unicodedata.category(c) in ("Cf", "Zs") and c != " " for c in form if c != " " and c in "​ 　﻿")


def test_conflicts_are_found():
    with pytest.raises(ConflictError):
        compile_table([("Ａ", "B", "width")])
    with pytest.raises(ConflictError):
        compile_look_alikes([("A", "А", ""), ("B", "А", "")])


SENTENCES = ["L’école de l’âme à Nîmes – une étude", "Über die Größe der Bücher", "Школа и учение о молитве", "Η σχολή και η προσευχή", "A educação divina e a oração", "perché lasciò la città"]


@pytest.mark.parametrize("text", SENTENCES)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250"])
def test_utf8_round_trip(text, wrong):
    raw = text.encode("utf-8")
    bad = "".join(bytes([b]).decode(wrong) if _can(b, wrong) else chr(b) for b in raw)
    new, garbled, whole = repair(bad)
    assert garbled and whole
    assert new == text


def _can(b, enc):
    try:
        bytes([b]).decode(enc)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("right, wrong, text", [("cp1251", "cp866", "Школа и учение о молитве"), ("cp1251", "latin-1", "Утраченные письма"), ("cp1253", "latin-1", "και το μαρτύριο"), ("koi8-r", "cp1251", "Образ Божий")])
def test_single_byte_round_trip(right, wrong, text):
    assert repair(text.encode(right).decode(wrong)) == (text, True, True)


def test_double_and_entities_and_lost():
    bad = "pédagogie".encode().decode("cp1252").encode().decode("cp1252")
    assert repair(bad) == ("pédagogie", True, True)
    assert repair("R&eacute;sum&eacute; de la pens&eacute;e")[:2] == ("Résumé de la pensée", True)
    assert repair("l���homme")[1:] == (True, False)


@pytest.mark.parametrize("text", [None, "", "plain", "The sigla Ã, Â and Ð are replaced by Å", "the sign √ and ¶, § and ±", "price € 48 (£ 41)", "‘Å’ is a letter", "Åström’s naïve reading", "librarу of Νeradion", "Школа", "§§ 4‒7 († 153)", *SENTENCES])
def test_nothing_garbled(text):
    assert repair(text)[:2] == (text, False)


def test_very_long_text():
    long_ = "Une étude sur l’âme. " * 20_000
    assert repair(long_) == (long_, False, True)
    assert canonical(long_ + "​") == long_


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "plain", [("A. Ek", None, None, None)], None, "x"), (2, None, None, "", "x"), (3, "The school", [(None, None, None, None), ("Ｅk", None, None, None), ("E​k", None, None, None)], "fÃ¼r alle", None),
            (3, "The school", [("Ek", None, None, None)], "fÃ¼r alle", None), (4, "fÃ¼r alle", [], "ok", ""),
        ],
        CORPUS,
    )


def test_tables(spark):
    c = rows(spark)
    assert sorted(map(tuple, p2_visual.found(c).collect())) == [(3, "authors"), (3, "title")]
    assert sorted(map(tuple, p5_encoding.found(c).collect())) == [(3, "abstract"), (4, "title")]
    forms = {(r["record_id"], r["field"], r["pos"]): r["form"] for r in p2_visual.canonical_forms(c).collect()}
    assert forms[(3, "authors", 1)] == "Ek" and forms[(3, "authors", 0)] == "Ek" or forms[(3, "authors", 1)] == "Ek"
    assert forms[(2, "title", 0)] is None and forms[(1, "authors", 0)] == "A. Ek"
    assert p2_visual.canonical_forms(c).count() == 5 + 5
    empty = c.where("false")
    assert p2_visual.found(empty).count() == p5_encoding.restored(empty).count() == p2_visual.canonical_forms(empty).count() == 0
