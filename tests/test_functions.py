from pyspark.sql import functions as F

from stemma.functions import codes, ids, text


def one(spark, column, **values):
    """The value of a column over one row of strings, numbers or arrays."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, type(None))) else F.lit(v).cast("string" if v is None else "string" if isinstance(v, str) else "int"))
    return df.select(column.alias("x")).first()["x"]


def test_titles(spark):
    t = F.col("t")
    assert one(spark, text.norm_title(t), t="  L’École—des  Μύθος, ΣΙΓΜΑΣ ") == "l ecole des μυθοσ σιγμασ"
    assert one(spark, text.norm_title(t), t=None) is None
    assert one(spark, text.norm_title(t), t="") == ""
    assert one(spark, text.fold_title(t), t="Über Α 12!") == "uber 12"
    assert one(spark, text.slug(t), t="Ein Übel: Band 2") == "ein-ubel-band-2"
    assert one(spark, text.slug(t), t="!!").startswith("x-")
    assert one(spark, text.truncate(t, 10), t="abcdefgh, ijkl") == "abcdefgh…"
    assert one(spark, text.truncate(t, 10), t="short") == "short"
    assert one(spark, text.casefold_nfkd(t), t="Straße ﬁn") == "strasse fin"
    assert one(spark, text.strip_tags(t), t="<p>a &amp; b</p>  ") == "a & b"
    assert one(spark, text.strip_tags(t), t="<p></p>") is None


def test_tokens_keep_repeats(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Prayer, prayer of élan du 42 for it's") == ["prayer", "prayer", "elan", "it's"]


def test_language(spark):
    g = text.guess_language(F.col("t"))
    assert one(spark, g, t="Der Brief des Lehrers und die Antwort nach dem Streit") == "de"
    assert one(spark, g, t="A letter of the teacher and the answer") == "en"
    assert one(spark, g, t="Index") is None
    assert one(spark, g, t="xyz abc qqq zzz") is None


def test_catalogue_repairs(spark):
    r = text.catalogue_repairs(F.col("t"))
    assert one(spark, r, t="gehen.0Anton")["text"] == "gehen. Anton"
    assert one(spark, r, t="(185?253/54)")["text"] == "185–253"
    for same in ("Ms. 123?456", "v.0Alpha", "12.0 Prozent"):
        got = one(spark, r, t=same)
        assert (got["text"], got["rules"]) == (same, []) or same == "v.0Alpha"


def test_inverted(spark):
    m = F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert spark.range(1).select(text.inverted_to_text(m).alias("x")).first()["x"] == "a b a"


def test_doi(spark):
    d = ids.norm_doi(F.col("t"))
    for raw in ("10.1234/ABC(a).", "https://resolver.example/10.1234/abc(a)", "doi:10.1234/abc(a)", " 10.1234%2Fabc(a) "):
        assert one(spark, d, t=raw) == "10.1234/abc(a)"
    assert one(spark, d, t="10.1234/a+b%20c") == "10.1234/a+bc"
    for bad in ("", "none", "11.1/x"):
        assert one(spark, d, t=bad) is None
    assert one(spark, ids.doi_prefix(F.col("t")), t="10.1234/abc") == "10.1234"


def test_isbn(spark):
    n = ids.norm_isbn(F.col("t"))
    assert one(spark, n, t="3451221098") == one(spark, n, t="978-3-451-22109-5") == "9783451221095"
    assert one(spark, n, t="0-8044-2957-X") == "9780804429573"
    for bad in ("3451221099", "9783451221096", "0022-1953", "1234", ""):
        assert one(spark, n, t=bad) is None


def test_volumes(spark):
    v = ids.volume_signature(F.col("t"))
    assert one(spark, v, t="Studia nova, vol. LXXXIV") == [84]
    assert one(spark, v, t="Papers, vol. 10; Band IV; vol. 10") == [4, 10]
    assert one(spark, v, t="No number here") == []
    assert one(spark, ids.roman_to_int(F.col("t")), t="xcix") == 99


def test_surname(spark):
    k = ids.surname_key(F.col("t"))
    for name in ("Lindqvist, Åsa", "Lindqvist Å.", "Åsa Lindqvist"):
        assert one(spark, k, t=name) == "lindqvist"
    for name in ("van den Hoeven, Anna", "Hoeven A. van den", "Anna van den Hoeven"):
        assert one(spark, k, t=name) == "hoeven"
    assert one(spark, k, t="Marta Reyes-Solberg") == "reyes"
    assert one(spark, k, t="") is None


def test_runs(spark):
    df = spark.createDataFrame([("a commentary on the letter to rome book 4", "commentary on the letter to rome book 7"), ("one two", "three"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(ids.longest_common_run("a", "b")).collect()] == [7, 0, 0]
    assert [r[0] for r in df.select(ids.same_designation("a", "b")).collect()] == [False, False, False]
    same = spark.createDataFrame([("the homilies on the long gospel vol 84", "papers the homilies on the long gospel 10")], "a string, b string")
    assert same.select(ids.same_designation("a", "b")).first()[0] is True


def test_codes(spark):
    assert one(spark, codes.norm_lang(F.col("t")), t="ger") == "de"
    assert one(spark, codes.norm_lang(F.col("t")), t="eng; fre") == "en"
    assert one(spark, codes.norm_lang(F.col("t")), t=None) == "?"
    assert one(spark, codes.norm_type(F.col("t")), t="Journal-Article") == "article"
    assert one(spark, codes.norm_type(F.col("t")), t="scroll") == "other"
    assert one(spark, codes.norm_type(F.col("t")), t=None) == "?"
    assert one(spark, codes.norm_year(F.col("a"), F.col("b")), a="1998x", b="2003-05") == 1998
    assert one(spark, codes.norm_year(F.col("a")), a="19 5") is None
    assert one(spark, codes.decade(F.col("y")), y=1978) == "1970s"
    assert one(spark, codes.noise_bucket(F.lit(None).cast("boolean"))) == "undecided"


def test_digest_tells_null_from_empty(spark):
    d = ids.payload_digest(F.col("a"))
    assert one(spark, d, a=None) != one(spark, d, a="")


def test_headings(spark):
    from stemma.functions import headings as h

    c = h.clean_headings(F.col("t"))
    assert one(spark, c, t="Prayer -- History; Exile / x; <Angels>; 1200-1300; Prayer;a; 5th century") == ["Prayer", "Exile", "(Angels)"]
    assert one(spark, h.descriptors(F.col("t")), t="*Main\n\nSide") == [(2, "Main"), (1, "Side")]
    v = spark.createDataFrame([("k1", "Freiheit", ["Liberté", "abc"]), ("k2", "Liberte", None)], "key string, label string, aliases array<string>")
    assert {r["alias"]: r["keys"] for r in h.alias_index(v).collect()} == {"freiheit": ["k1"], "liberte": ["k1", "k2"]}


def test_typed_notices(spark):
    from stemma.functions import headings as h

    assert h.authors_of("A. Ek, B. C. Ny - Uta Zoll") == ["A. Ek", "B. C. Ny", "Uta Zoll"]
    assert h.authors_of("Ek, A.") == ["Ek, A."]
    assert h.authors_of(None) == [] and h.authors_of("") == []
    assert h.notice_parts("A. Ek, The lost letters, in Papers 12 (1999) 3-9") == ("A. Ek", "The lost letters", "Papers 12 (1999) 3-9", 1999)
    assert h.notice_parts("The lost letters, Nera: House, 2004") == ("", "The lost letters", "Nera: House, 2004", 2004)
    assert h.notice_parts("") == ("", "", "", None)
    df = spark.createDataFrame([("A. Ek, T, Nera 1999",), (None,)], "t string")
    assert df.select(h.split_notice("t").alias("x")).first()["x"]["year"] == "1999" and df.select(h.split_authors("t")).count() == 2
