import json
import os

import pytest

from stemma.operators.gates import GateClosed
from stemma.sources import paged, readers, writers
from stemma.streaming import tags as st


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return "file://" + str(path)


def test_json_lines(spark, tmp_path):
    put(f"{tmp_path}/raw/a/records.jsonl", '{"source":"a","source_id":"1","title":"T","year":1999}\n{broken\n')
    put(f"{tmp_path}/raw/b/records.jsonl", '{"source":"b","source_id":"2"}\n')
    good, bad = readers.split_corrupt(readers.json_lines(spark, f"file://{tmp_path}/raw/*/records.jsonl").cache())
    assert sorted(r["source_id"] for r in good.collect()) == ["1", "2"] and bad.count() == 1
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        readers.json_lines(spark, f"file://{tmp_path}/raw/a/records.jsonl", strict=True).collect()


def test_array_or_lines(spark, tmp_path):
    a = put(f"{tmp_path}/a.json", '[{"source":"a","source_id":"1"},\n {"source":"a","source_id":"2"}]')
    b = put(f"{tmp_path}/b.json", '{"source":"a","source_id":"1"}\n')
    assert readers.json_any(spark, a).count() == 2 and readers.json_any(spark, b).count() == 1


def test_polymorphic(spark, tmp_path):
    p = put(f"{tmp_path}/p.jsonl", '{"source":"a","source_id":"1","doi":["10.1/x"],"year":[2001],"authors":["A B"]}\n{"source":"a","source_id":"2","doi":"10.1/y","year":"1999-02","authors":[{"name":"C"}]}\n')
    got = {r["source_id"]: (r["doi"], r["year"], r["authors"]) for r in readers.polymorphic_lines(spark, p).collect()}
    assert got == {"1": ("10.1/x", 2001, ["A B"]), "2": ("10.1/y", 1999, ["C"])}


def test_signatures_policy_vocabulary(spark, tmp_path):
    t = put(f"{tmp_path}/ids.tsv", "C1\ta:1|b:2:3\nC2\ta:9\n")
    assert sorted(map(tuple, readers.signatures(spark, t).collect())) == [("C1", "a", "1"), ("C1", "b", "2:3"), ("C2", "a", "9")]
    md = "# P\n```json\n{\"other\": 1}\n```\n```json\n" + json.dumps({"attribution": {"a": {"label": "A", "url_template": "u", "hosts": ["a.example"], "license": "CC0"}}}) + "\n```\n"
    assert readers.policy_in_text(spark, put(f"{tmp_path}/policy.md", md)).first()["hosts"] == ["a.example"]
    assert readers.parse_policy_block(md)["attribution"]["a"]["label"] == "A"
    with pytest.raises(ValueError):
        readers.parse_policy_block("nothing")
    v = put(f"{tmp_path}/themes.json", '{"version": "1", "themes": {"t.a": {"label": "A"}, "t.b": {"label": "B"}}}')
    assert readers.vocabulary(spark, v, "themes").count() == 2


def test_marc_and_html(spark, tmp_path):
    xml = """<collection><record><controlfield tag="001">77</controlfield><datafield tag="245"><subfield code="a">Title :</subfield><subfield code="b">rest /</subfield></datafield>
    <datafield tag="700"><subfield code="a">Ek, A.</subfield></datafield><datafield tag="264"><subfield code="c">c1987.</subfield></datafield></record></collection>"""
    r = readers.marc_xml(spark, put(f"{tmp_path}/m.xml", xml)).first()
    assert (r["source_id"], r["title"], r["author"], r["year"]) == ("77", "Title: rest", "Ek, A.", 1987)
    page = spark.createDataFrame([("<table><tr><th>Author:</th><td> Ek <b>A</b></td></tr><tr><th>Author:</th><td>No</td></tr></table><select name='s'><option value='1'>One</option></select>",)], "h string")
    got = page.select(readers.label_cells(page.h).alias("m"), readers.select_options(page.h, "s").alias("o")).first()
    assert got["m"] == {"Author": "Ek A"} and [tuple(x) for x in got["o"]] == [("1", "One")]


def test_paged_source(spark, tmp_path):
    for s in ("2001", "2002"):
        put(f"{tmp_path}/{s}-0.json", json.dumps({"rows": [{"source_id": s + "a", "title": "A"}, {"source_id": s + "a"}], "next": "t1"}))
        put(f"{tmp_path}/{s}-t1.json", json.dumps({"rows": [{"source_id": s + "b", "title": None}], "next": None}))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("folder", str(tmp_path)).option("slices", '["2001", "2002"]').load()
    assert sorted(r["source_id"] for r in df.collect()) == ["2001a", "2001b", "2002a", "2002b"]


def test_walk_waits_and_restarts():
    waits, calls = [], []

    def fetch(slice_, token):
        calls.append(token)
        if len(calls) == 1:
            return {"rows": [], "status": 429, "retry_after": "7200"}
        if token == "dead":
            raise paged.DeadToken
        return {"rows": [{"source_id": "1"}], "next": "dead"}

    rows = paged.walk(fetch, "x", sleep=waits.append)
    assert next(rows)["source_id"] == "1" and waits == [3600]
    with pytest.raises(RuntimeError, match="not whole"):
        next(rows)
    assert paged.retry_after("900") == 900 and paged.retry_after(None) is None and paged.retry_after("soon") is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", "1", "T", "long text", "closed")], "source string, source_id string, title string, abstract string, abstract_rights string")
    with pytest.raises(GateClosed):
        writers.guarded_json(df, f"file://{tmp_path}/out")
    writers.guarded_json(df.drop("abstract", "abstract_rights"), f"file://{tmp_path}/ok")
    r = writers.release(df, strip=False, withdraw="^closed$").first()
    assert r["abstract"] is None and r["abstract_withheld"] is True
    assert "abstract" not in writers.release(df).columns
    old = spark.createDataFrame([("1", "T", None, ["q1"])], "source_id string, title string, doi string, query_matched array<string>")
    new = spark.createDataFrame([("1", "U", "10.1/x", ["q2", "q1"]), ("2", "V", None, None)], old.schema)
    got = {r["source_id"]: tuple(r)[1:] for r in writers.upsert(old, new, "source_id", ["title", "doi"], ["query_matched"]).collect()}
    assert got == {"1": ("T", "10.1/x", ["q1", "q2"]), "2": ("V", None, [])}
    writers.by_source(df, f"file://{tmp_path}/parts")
    assert spark.read.parquet(f"file://{tmp_path}/parts").where("source = 's'").count() == 1
    assert writers.union_files(df.select("source"), df.select("source", "title")).columns == ["source", "title"]


def row(i, notice, rel, at):
    return (i, notice, rel, None, [], [], [], 0.5, None, False, "w", "r", "m", True, "v", "p", "0" * 16, at)


def test_stream_rejects_and_is_idempotent(spark, tmp_path):
    rows = [row(1, "a:1", "core", "t1"), row(2, "a:1", "none", "t2"), row(3, None, "core", "t1"), row(4, "a:2", "maybe", "t1")]
    df = spark.createDataFrame(rows, st.SCHEMA)
    df.write.parquet(f"file://{tmp_path}/log")
    t = st.LatestTable(f"file://{tmp_path}/table")
    st.run_available(spark, f"file://{tmp_path}/log", t, f"file://{tmp_path}/cp")
    assert [(r["notice_id"], r["relevance"]) for r in t.read(spark).collect()] == [("a:1", "none")]
    assert spark.read.parquet(f"file://{tmp_path}/table/rejects/*").count() == 2
    t.apply(df, 0)  # a batch that is replayed
    assert t.read(spark).count() == 1
    spark.createDataFrame([row(5, "a:1", "partial", "t0")], st.SCHEMA).write.mode("append").parquet(f"file://{tmp_path}/log")
    st.run_available(spark, f"file://{tmp_path}/log", t, f"file://{tmp_path}/cp")
    assert t.read(spark).first()["relevance"] == "none"  # late and older: it does not win


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([row(1, "a:1", "core", "2024-01-01T00:00:00Z"), row(2, "a:2", "core", "2024-01-02T00:00:00Z"), row(3, "a:3", "none", "2024-02-02T00:00:00Z")], st.SCHEMA).write.parquet(f"file://{tmp_path}/log")
    q = st.windowed_counts(st.read_log(spark, f"file://{tmp_path}/log")).writeStream.format("memory").queryName("wk").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["relevance"], r["n"]) for r in spark.table("wk").collect()) == [("core", 2), ("none", 1)]
