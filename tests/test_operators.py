import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import gates, golden, graph, joins, linking, ranking, search, stats, tags, tree
from stemma.operators.components import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9), (7, None), (3, 1), (1, 2)], "src bigint, dst bigint")
    assert rows(connected_components(e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert connected_components(e.where("false")).count() == 0
    path = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert {r["component"] for r in connected_components(path).collect()} == {0}


def test_mid_rank_and_percentile(spark):
    df = spark.createDataFrame([("g", 0), ("g", 0), ("g", 5), ("g", 10), ("h", 3), ("h", None)], "k string, v int")
    got = {(r["k"], r["v"]): (r["rank_num"], r["rank_den"]) for r in ranking.mid_rank(df, ["k"], "v").collect()}
    assert got == {("g", 0): (2, 8), ("g", 5): (5, 8), ("g", 10): (7, 8), ("h", 3): (1, 2), ("h", None): (None, None)}
    p = {(r["k"], r["v"]): (r["pct_num"], r["pct_den"]) for r in ranking.min_rank_percentile(df, ["k"], "v").collect()}
    assert p[("h", 3)] == (1, 2) and p[("g", 0)] == (0, 3) and p[("g", 10)] == (3, 3)


def test_ladder_falls_back(spark):
    df = spark.createDataFrame([("a", "x", i) for i in range(8)] + [("a", "y", 3), ("b", None, 1), ("b", None, None)], "d string, t string, v int")
    out = ranking.cohort_ladder(df, [("d+t", ["d", "t"]), ("d", ["d"]), ("all", [])], "v")
    got = {(r["d"], r["t"], r["v"]): (r["cohort_level"], r["cohort_size"]) for r in out.collect()}
    assert got[("a", "x", 0)] == ("d+t", 8) and got[("a", "y", 3)] == ("d", 9) and got[("b", None, 1)] == ("all", 10) and got[("b", None, None)] == (None, None)


LOG = "tag_row_id bigint, notice_id string, relevance string, tagged_at string"


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, "A", "core", "t1"), (2, "B", "none", "t1"), (3, "C", "none", "t1"), (4, "A", "partial", "t2"), (5, "A", "core", "t0")], LOG)
    assert rows(tags.latest(log).select("notice_id", "relevance")) == [("A", "partial"), ("B", "none"), ("C", "none")]
    assert rows(tags.superseded(log).select("tag_row_id")) == [(1,), (5,)]
    table, history = tags.compact(log)
    again, more = tags.compact(table)
    assert joins.same_rows(table, again) and more.count() == 0 and history.count() == 2
    assert rows(tags.first_position(log).select("notice_id", "first_row", "winning_row", "superseded"))[0] == ("A", 1, 4, 2)


def test_resume_and_gaps(spark):
    log = spark.createDataFrame([("n1", "d1", "w1", "v2", "v2"), ("n2", "old", "w1", "v2", "v2"), ("n3", "d3", "w0", "v2", "v2")], "notice_id string, input_digest string, wave string, prompt_version string, vocabulary_version string")
    notices = spark.createDataFrame([("n1", "d1"), ("n2", "d2"), ("n3", "d3"), ("n4", "d4")], "notice_id string, digest string")
    got = {r["notice_id"]: r["stale"] for r in tags.to_tag(notices, log, "digest", "w1", "v2", "v2").collect()}
    assert got == {"n2": True, "n3": True, "n4": False}


def answer(**kw):
    base = {"id": 1, "relevance": "core", "relevance_none_reason": None, "works": ["w1"], "themes": ["t1"], "approaches": ["a1"], "confidence": 0.9, "justification": "j", "needs_review": False, "curated": False, "by_subject": False}
    return base | kw


SCHEMA = "id int, relevance string, relevance_none_reason string, works array<string>, themes array<string>, approaches array<string>, confidence double, justification string, needs_review boolean, curated boolean, by_subject boolean"


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, {"relevance": "core", "needs_review": False, "repairs": []}),
        ({"relevance": "none", "curated": True, "themes": []}, {"relevance": "marginal", "floor_applied": True, "themes": ["context.biography"]}),
        ({"relevance": "none", "relevance_none_reason": "homonym", "curated": True, "themes": []}, {"relevance": "none", "floor_applied": False, "themes": []}),
        ({"by_subject": True}, {"relevance": "marginal", "ceiling_applied": True, "needs_review": True}),
        ({"confidence": 2.0}, {"confidence": 1.0, "needs_review": True, "repairs": ["confidence clamped"]}),
        ({"confidence": None}, {"confidence": 0.0, "needs_review": True}),
        ({"works": ["w1", "zz", "w1", "unspecified"]}, {"works": ["w1"], "repairs": ["dropped works:zz", "unspecified removed"]}),
        ({"works": None}, {"works": ["unspecified"]}),
        ({"justification": " "}, {"justification": "no justification returned", "needs_review": True}),
        ({"relevance": "none", "relevance_none_reason": "unclear"}, "reason not in the closed list: unclear"),
        ({"relevance": "maybe"}, "relevance not in vocabulary: maybe"),
        ({"themes": ["zz"]}, "no theme survived"),
        ({"approaches": []}, "no approach survived"),
    ],
)
def test_validation(spark, given, want):
    df = spark.createDataFrame([tuple(answer(**given).values())], SCHEMA)
    good, bad = tags.validate(df, ["w1", "w2", "unspecified"], ["t1", "t2"], ["a1"])
    if isinstance(want, str):
        assert good.count() == 0 and bad.first()["error"] == want
    else:
        r = good.first().asDict()
        assert {k: r[k] for k in want} == want


def test_remap(spark):
    votes = spark.createDataFrame([("o1", "n1", 3), ("o2", "n2", 1), ("o2", "n3", 2), ("o3", "n1", 9)], "old_id string, new_id string, shared bigint")
    got = {r["old_id"]: (r["new_id"], r["how"]) for r in tags.remap(votes).collect()}
    assert got == {"o1": ("n1", "unique"), "o2": ("n3", "majority")}
    with pytest.raises(tags.RemapRefused):
        tags.checked_remap(20, 1)
    tags.checked_remap(20, 20)
    tags.checked_remap(20, 10, force=True)


def test_cascade_drops_disagreeing_donors(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id int, k1 string, k2 string")
    d1 = spark.createDataFrame([("a", "v1"), ("b", "p"), ("b", "q"), (None, "never")], "k1 string, value string")
    d2 = spark.createDataFrame([("y", "v2"), ("x", "late")], "k2 string, value string")
    assert rows(joins.cascade(left, "id", [("first", d1, None), ("second", d2, None)], "value").select("id", "value", "method")) == [(1, "v1", "first"), (2, "v2", "second"), (3, None, None)]


def test_projection(spark):
    s = "record_id int, title_key string, author_key string, type string, year int"
    t = spark.createDataFrame([(1, "t", "a", "article", 2022), (2, "t", "a", "book", 1994), (3, "t", "a", "?", 1994), (4, "t", None, "book", 1994), (5, "u", "a", "book", 2000)], s)
    d = spark.createDataFrame([(9, "t", "a", "article", 2021, 7), (8, "t", "a", "book", 1995, 4), (7, "u", "a", "book", 2000, 1), (6, "u", "a", "book", 2001, 2)], s + ", n int")
    assert rows(joins.project_by_title(t, d, "n").select("record_id", "n")) == [(2, 4)]


def test_union_matches_sequential(spark):
    """The replay per component equals one pass over all edges, on random small graphs."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(4, 12)
        state = {i: ({f"10.{rng.randint(1, 3)}/{rng.randint(1, 4)}"} if rng.random() < 0.5 else set(), set(), {rng.randint(1, 2)} if rng.random() < 0.3 else set()) for i in range(n)}
        state = {i: (d, {x.split("/")[0] for x in d}, v) for i, (d, _, v) in state.items()}
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() < 0.5) for _ in range(n)]
        whole = linking.GuardedUnion(state)
        for e in edges:
            whole.join(*e)
        comp = {i: i for i in range(n)}

        def find(i, comp=comp):
            while comp[i] != i:
                i = comp[i]
            return i

        for i, j, _s in edges:
            comp[max(find(i), find(j))] = min(find(i), find(j))
        parts = {}
        for i in range(n):
            parts.setdefault(find(i), []).append(i)
        for nodes in parts.values():
            u = linking.GuardedUnion({i: state[i] for i in nodes})
            for i, j, s in edges:
                if i in nodes:
                    u.join(i, j, s)
            assert {i: u.find(i) for i in nodes} == {i: whole.find(i) for i in nodes}


CORPUS = "record_id bigint, source string, source_id string, title string, authors array<struct<name:string,role:string,type:string,gnd:string>>, year int, doi string, isbn array<string>, isbn_issn string"


def record(i, title, name, year, doi=None, isbn=None):
    return (i, "s", str(i), title, [(name, "aut", "person", None)] if name else None, year, doi, isbn, None)


def test_guarded_clusters(spark):
    long_ = "A commentary on the hymn of the seven gates"
    df = spark.createDataFrame(
        [
            record(1, "Short", "Ek, A.", 2000, "10.1000/a"), record(2, "Short", "A. Ek", 2001, "10.2000/b"), record(3, long_, "Ek, A.", 2000, "10.1000/c"), record(4, long_, "Ek, A.", 2001, "10.2000/d"), record(5, long_, "Ek, A.", 2001, "10.1000/e"),
            record(6, "X", None, 1990, "10.9000/z"), record(7, None, None, None, "doi:10.9000/Z"), record(8, "Book one", "Ny, B.", 1951, None, ["9783451221095"]), record(9, "Book won", "Ny, B.", 1991, None, ["3451221098"]),
            record(10, "Buch eins", "Ny, B.", 1951, None, ["3451221098"]), record(11, None, None, None),
        ],
        CORPUS,
    )
    got = {r["record_id"]: r["cluster"] for r in linking.cluster(df).collect()}
    assert got[1] != got[2]  # two DOIs on a short title
    assert got[3] == got[4] and got[5] != got[3]  # other registrant and long title; same registrant refused
    assert got[6] == got[7]
    assert got[8] == got[10] != got[9]  # ISBN links but for a reissue
    assert got[11] == 11


def test_isbn_verdicts(spark):
    def verdicts(*recs):
        return sorted(r["verdict"] for r in linking.isbn_pairs(linking.keyed(spark.createDataFrame(list(recs), CORPUS))).collect())

    isbn = ["9783451221095"]
    assert verdicts(record(1, "One title", "A", 1951, None, isbn), record(2, "One title", "A", 1991, None, isbn)) == ["year_gap"]
    assert verdicts(record(1, "Titel Band I", "A", 2000, None, isbn), record(2, "Titel Band II", "A", 2000, None, isbn)) == ["volume_marker"]
    assert verdicts(record(1, "T", "A", None, None, isbn), record(2, "U", "A", 2016, None, isbn)) == ["linked"]
    assert verdicts(*[record(i, f"Title number {i}", "A", 2000, None, isbn) for i in range(8)]) == []


def test_anchors_do_not_chain(spark):
    b = spark.createDataFrame([("b", i, y, 1, 30) for i, y in enumerate([2000, 2001, 2002, 2003, None, None])], "block string, record_id bigint, year int, titles int, length int")
    assert {r["record_id"]: r["anchor"] for r in linking.anchored(b).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_golden(spark):
    s = "cluster string, priority int, record_id bigint, source string, source_id string, title string, year int, url string, abstract string, abstract_rights string"
    df = spark.createDataFrame([("c", 2, 1, "x", "1", "T", 2001, "ux", "text", "r1"), ("c", 1, 2, "y", "2", " ", 2000, "uy", None, None), ("c", 3, 3, "z", "3", "t.", None, "uz", "text", "r2")], s)
    m = golden.merge(df, "cluster", "priority", ["record_id"], ("title", "year")).first().asDict()
    assert (m["title"], m["title_from"], m["year"], m["year_from"], m["abstract_url"], m["abstract_rights"]) == ("T", "x:1", 2000, "y:2", "ux", "r1")
    merged = golden.merge(df, "cluster", "priority", ["record_id"], ("title", "year"))
    assert rows(golden.conflicts(df, merged, "cluster", ("title", "year")).select("field", "value")) == [("year", "2001")]
    assert golden.rights_conflicts(df, "cluster").first()["rights"] == 2
    with pytest.raises(golden.DuplicateKey):
        golden.assert_unique(df, "cluster")


def test_pagerank_against_loop(spark):
    e = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "a"), ("p3", "b"), ("p3", "b")], "src string, dst string")
    got = {r["node"]: r["score"] for r in graph.pagerank(e, rounds=10).collect()}
    adj = {"p1": ["a", "b"], "p2": ["a"], "p3": ["b"], "a": ["p1", "p2"], "b": ["p1", "p3"]}
    want = dict.fromkeys(adj, 1 / 5)
    for _ in range(10):
        want = {n: 0.15 / 5 + 0.85 * sum(want[m] / len(adj[m]) for m in adj if n in adj[m]) for n in adj}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in adj)


def test_series_and_coverage(spark):
    c = spark.createDataFrame([(2000, 3), (2002, 1)], "year int, n int")
    assert rows(stats.zero_filled(c, "year", 2000, 2002)) == [(2000, 3), (2001, 0), (2002, 1)]
    t = spark.createDataFrame([("k", "Aa"), ("k", "Bbb"), ("k", "Ccc"), ("l", "x")], "key string, label string")
    assert rows(stats.top_labels(t, "key", "label", 1)) == [("k", "Bbb", 3)]


DOCS = [(1, "Prayer and exile in the city", 1971, "en"), (2, "Prayer", 1980, "en"), (3, "Exile and prayerful life", None, "de"), (4, "Romans in Rome", 1990, "en"), (5, None, 2000, None)]


def docs(spark):
    return search.documents(spark.createDataFrame(DOCS, "doc_id int, text string, year int, lang string"), ["text"], F.col("text"))


@pytest.mark.parametrize(
    "query, ids",
    [
        ("prayer", {1, 2, 3}), ("ayer", set()), ("prayer -exile", {2}), ('"prayer and exile"', {1}), ("year:1971-1985", {1, 2}), ("year:<1980", {1}), ("year:>=1980 -lang:de", {2, 4, 5}), ("lang:de prayer", {3}), ("-year:1971 prayer", {2, 3}),
        ("", set()), ("the", set()), ("zzyzx", set()), ("foo:prayer", {1, 2, 3}), ('-"prayer and exile" prayer', {2, 3}), ("year:1990", {4}),
    ],
)
def test_search_rules(spark, query, ids):
    assert {r["doc_id"] for r in search.scored(docs(spark), query).where("score > 0").collect()} == ids


def test_search_says_when_it_widens(spark):
    v = search.search(docs(spark), "prayer exile zzyzx", floor=2)
    assert (v.carrying_all_terms, v.listed, v.hit_depth, v.widened, v.absent) == (0, 2, 2, True, ["zzyzx"])
    assert "0 records carry all 3 terms; 2 carry at least 2" in v.sentence()
    v = search.search(docs(spark), "prayer exile", floor=2)
    assert (v.carrying_all_terms, v.listed, v.widened) == (2, 2, False)
    v = search.search(docs(spark), "prayer", floor=100)
    assert (v.listed, v.hit_depth, v.widened) == (3, 1, False)
    assert search.search(docs(spark), "").listed == 0
    assert search.depth_of([(2, False, 3), (1, False, 20)], 2) == 1


def test_heading_is_bounded(spark):
    assert {r["doc_id"] for r in search.scored(docs(spark), "rome").where("vocab_hit").collect()} == {4}


def test_density(spark):
    n = spark.createDataFrame([("theme/freedom", "liberté et grâce", 4), ("theme/empty", "liberté", 0), ("theme/other", "prière", 9)], "node_id string, label string, n_notices int")
    assert [r["node_id"] for r in tree.select_nodes(n, "la liberté chez lui").collect()] == ["theme/freedom"]
    for q in ("zzzzyyyyxxxx", "quantum chromodynamics", "1234", ""):
        assert tree.select_nodes(n, q).count() == 0
    b = spark.createDataFrame([("theme/freedom", "n1"), ("theme/freedom", "n2")], "node_id string, notice_id string")
    assert tuple(tree.density(b, n.where("false").select("node_id"), 5).first()) == (0, 5)


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://a.example.org/x", True), ("http://a.example.org:8080/", True), ("ftp://a.example.org", False), ("https://user@a.example.org", False), ("https://a.example.org\\@b.org", False), ("https://127.0.0.1/x", False), ("https://10.0.0.8/x", False),
        ("https://localhost/x", False), ("https://a.example.org/%252e%252e/x", False), ("https://a.example.org/../x", False), ("https://a.example.org:99999/", False), ("https://8.8.8.8/x", True), ("", False), (None, False), ("//a.org", False),
    ],
)
def test_addresses(url, ok):
    assert gates.address_ok(url) is ok


def test_attribution(spark):
    p = spark.createDataFrame([("s", ["s.example"])], "source string, hosts array<string>")
    r = spark.createDataFrame([(1, "s", "https://s.example/1"), (2, "s", "https://www.s.example/1"), (3, "s", "https://evils.example/1"), (4, "s", None), (5, "t", "https://s.example")], "id int, source string, url string")
    assert [x[1] for x in rows(gates.attribution(r, p).select("id", "status"))] == ["attributed", "attributed", "bad_host", "no_url", "unknown_source"]
    with pytest.raises(gates.GateClosed):
        gates.require_none(r.where("id = 5"), "unlisted")
    gates.one_population(r, r)


def test_forbidden_keys(spark):
    t = spark.createDataFrame([], "id int, deep array<struct<name:string,inner:map<string,struct<Abstract_text:string>>>>, api_key string").schema
    assert gates.forbidden_paths(t) == ["deep[].inner{}.Abstract_text", "api_key"]


def test_many_copies_are_one_node(spark):
    copies = [record(i, "The one book of all", "Ny, B.", 2001, None, ["9783451221095"]) for i in range(1, 41)]
    other = [record(100, "The one book of all", "Ny, B.", 2002, "10.1000/x", ["3451221098"]), record(101, "Nothing alike", "Ek, A.", 1990)]
    got = {r["record_id"]: r["cluster"] for r in linking.cluster(spark.createDataFrame(copies + other, CORPUS)).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == 1 and got[101] == 101
    empty = spark.createDataFrame([], CORPUS)
    assert linking.cluster(empty).count() == 0
