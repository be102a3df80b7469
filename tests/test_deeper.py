"""Greedy trails, mappers, readers with line numbers, paged streams."""

import json
import random

import pytest

from stemma.operators import graph
from stemma.sources import mappers, paged, readers


def test_greedy_trails_are_those_of_the_sequence(spark):
    rng = random.Random(3)
    links = {}
    for _ in range(160):
        a, b = sorted(rng.sample("abcdefghijklmnopqrst", 2))
        links[a, b] = rng.randint(4, 9)
    want, used = set(), {}
    for (a, b), w in sorted(links.items(), key=lambda x: (-x[1], x[0])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.add((a, b, w))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a string, b string, weight int")
    assert {tuple(r) for r in graph.greedy_trails(df).collect()} == want
    assert graph.greedy_trails(df.where("false")).count() == 0


PAGES = {
    "openalex": {"results": [{"id": "W1", "doi": "https://doi.org/10.5555/AB", "display_name": "On rivers", "publication_year": 1999, "language": "en", "type": "article", "authorships": [{"author": {"display_name": "Ann  Lee"}}, {"author": {}, "raw_author_name": "B. Roe"}, {}], "primary_location": {"source": {"display_name": "Waters"}}, "abstract_inverted_index": {"All": [0], "flows": [1, 2]}}, {"id": None, "title": "x"}]},
    "crossref": {"message": {"items": [{"DOI": "10.5555/Q", "title": ["T"], "container-title": ["C"], "author": [{"given": "Ann", "family": "Lee"}, {"name": "A Society"}], "issued": {"date-parts": [[None]]}, "created": {"date-parts": [[2003, 4]]}, "abstract": "<jats:p>All &amp; more</jats:p>", "ISBN": ["978"]}]}},
    "semanticscholar": {"data": [{"paperId": "p1", "title": "T", "venue": "", "year": 2001, "authors": [{"name": "Ann Lee"}, {"name": ""}], "externalIds": {"DOI": "10.5555/z"}, "abstract": None}]},
    "sbn": {"briefRecords": [{"codiceIdentificativo": "IT\\ICCU\\ABC\\01", "titolo": "Fiumi", "autorePrincipale": "Lee, Ann", "nomi": ["[Autore] Lee, Ann", "[Curatore] Roe, B."], "pubblicazione": "Roma : Acque, 1987", "livello": "Monografia"}, {"titolo": "no key"}]},
    "thesesfr": {"theses": [{"nnt": "2005X1", "titrePrincipal": "Fleuves", "auteurs": [{"nom": "Lee", "prenom": "Ann"}], "dateSoutenance": "12/05/2005", "resumes": {"en": "Of rivers."}}]},
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_mappers(spark, name):
    pages = spark.createDataFrame([(json.dumps(PAGES[name]), "clash"), (None, "x"), ("no json", "x"), ("{}", "x")], "page string, title string")
    rows = mappers.MAPPERS[name](pages).collect()
    assert len(rows) == 1 and rows[0].source == name
    r = rows[0]
    names = [a.name for a in r.authors]
    if name == "openalex":
        assert (r.source_id, r.doi, r.title, r.year, r.container, r.abstract) == ("W1", "10.5555/ab", "On rivers", 1999, "Waters", "All flows flows") and names == ["Ann Lee", "B. Roe"]
    elif name == "crossref":
        assert (r.doi, r.year, r.abstract, names) == ("10.5555/q", 2003, "All & more", ["Ann Lee", "A Society"])
    elif name == "semanticscholar":
        assert (r.container, r.abstract_rights, names) == (None, None, ["Ann Lee"])
    elif name == "sbn":
        assert (r.source_id, r.year, names) == ("ABC01", 1987, ["Lee, Ann", "Roe, B."])
    else:
        assert (r.year, r.language, r.abstract, names) == (2005, "en", "Of rivers.", ["Lee Ann"])


def test_rss_ids(spark):
    page = "<item><link>https://x.example/Record/123456789X</link><guid>https://x.example/Record/123456789x</guid></item><item><link> https://x.example/Search </link></item>"
    assert [r.source_id for r in mappers.rss_ids(spark.createDataFrame([(page,), (None,)], "page string")).collect()] == ["123456789X"]


def test_lines_are_named(spark, tmp_path):
    good = '{"source": "s", "source_id": "1"}\n'
    (tmp_path / "a.jsonl").write_text(good * 3)
    (tmp_path / "b.jsonl").write_text(good + "\n" + good + "{broken\n" + good)
    bad = readers.bad_lines(spark, f"file://{tmp_path}/*.jsonl").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line, r.text) for r in bad] == [("b.jsonl", 4, "{broken")]
    with pytest.raises(ValueError, match="b.jsonl:4"):
        readers.strict_lines(spark, f"file://{tmp_path}/*.jsonl")
    assert readers.strict_lines(spark, f"file://{tmp_path}/a.jsonl").count() == 3


def test_arrays_and_lines_in_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"source": "s", "source_id": "1"},\n {"source": "s", "source_id": "2"}]')
    (tmp_path / "b.json").write_text('{"source": "s", "source_id": "3"}\n')
    assert sorted(r.source_id for r in readers.json_any(spark, f"file://{tmp_path}/*.json").collect()) == ["1", "2", "3"]


def pages(slice_, token, options):
    n = int(token or 0)
    return {"rows": [{"source_id": f"{slice_}{n}", "title": "T"}], "next": str(n + 1) if n < 2 else None}


def test_paged_stream_resumes_at_its_cursor(spark, tmp_path):
    options = {"slices": '["a", "b"]', "fetch": "tests.test_deeper:pages"}
    r = paged._Stream(options)
    at, got = r.initialOffset(), []
    while at["next"]:
        rows, then = r.read(at)
        rows = list(rows)
        assert list(paged._Stream(options).readBetweenOffsets(at, then)) == rows
        got += [x[1] for x in rows]
        at = then
    assert sorted(got) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert list(r.read(at)[0]) == [] and r.read(at)[1] == at
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(**options).load()
    assert sorted(x.source_id for x in df.collect()) == sorted(got)


class Asked:
    def gap(self, words):
        return {"sentence": words}


def test_command_line(capsys):
    from stemma.__main__ import main

    assert main(["gap", "divine", "pedagogy", "--data", "x", "--json"], Asked()) == 0
    assert json.loads(capsys.readouterr().out) == {"sentence": "divine pedagogy"}
    with pytest.raises(SystemExit):
        main(["gap", "--data", "x"], Asked())
