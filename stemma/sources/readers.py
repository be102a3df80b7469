"""Scans of line JSON, JSON arrays, tab-separated tables, policies in text, vocabularies, XML and HTML."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "source string, source_id string, title string, authors array<struct<name:string,role:string,type:string,gnd:string>>, year int, language string, container string, type string, url string, "
    "doi string, isbn array<string>, isbn_issn string, abstract string, abstract_rights string, relation string, noise_guess boolean, query_matched array<string>"
)


def json_lines(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = False) -> DataFrame:
    """Line JSON under a glob: bad lines are kept apart in ``_corrupt_record``, or fatal when strict.

    Adds the file (``_file``) and where the block of the line begins in it (``_block``).
    """
    r = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return r.json(path) if strict else r.json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)."""
    bad = F.col("_corrupt_record").isNotNull()
    return df.where(~bad).drop("_corrupt_record"), df.where(bad).select("_file", "_block", "_corrupt_record")


def json_any(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Files that are each either line JSON or one JSON array: told, file by file, by the first sign that is no blank."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).where("at = 0 and trim(value) != ''")
    first = lines.groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "i").alias("sign"))
    arrays = [r["file"] for r in first.where("sign = '['").select("file").collect()]  # one row per file
    plain = [r["file"] for r in first.where("sign != '['").select("file").collect()]
    out = [spark.read.schema(schema).option("multiLine", multi).json(files) for files, multi in ((arrays, True), (plain, False)) if files]
    if not out:
        return spark.createDataFrame([], schema)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def bad_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """(file, line, text) of the lines that are no JSON of the schema; lines count from 1.

    Lines are counted per block of a file, so a file is read in as many tasks as it has blocks.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    begins = t.groupBy("file", "block").agg(F.min("i").alias("from"), F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    bad = t.where("trim(value) != ''").where(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())
    return bad.join(begins, ["file", "block"]).select("file", F.expr("before + i - from + 1").alias("line"), F.col("value").alias("text"))


def strict_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Line JSON of which every line must be right; the first bad one is named by file and line."""
    first = bad_lines(spark, path, schema).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}:{first[0]['line']}: no record: {first[0]['text'][:120]}")
    return spark.read.schema(schema).json(path)


def polymorphic_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose fields are now scalars, now lists, now objects, as VARIANT coerced to one shape."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v"), "value").where("v is not null")
    s = lambda p: F.try_variant_get("v", p, "string")
    return v.select(s("$.source").alias("source"), s("$.source_id").alias("source_id"), s("$.title").alias("title"), F.coalesce(s("$.doi[0]"), s("$.doi")).alias("doi"), F.coalesce(F.try_variant_get("v", "$.year[0]", "int"), F.substring(s("$.year"), 1, 4).try_cast("int")).alias("year"), names_of(F.col("value")).alias("authors"))


def names_of(line: Column) -> Column:
    """Author names from strings or from objects with a name."""
    objects = F.from_json(line, "authors array<struct<name:string>>")["authors"]["name"]
    strings = F.from_json(line, "authors array<string>")["authors"]
    plain = F.filter(strings, lambda x: ~x.startswith("{"))
    return F.coalesce(F.when(F.size(plain) > 0, plain), F.filter(objects, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """id TAB source:id|source:id lines: (cluster, source, source_id)."""
    t = spark.read.option("sep", "\t").schema("cluster string, signature string").csv(path)
    p = t.select("cluster", F.explode(F.split("signature", r"\|")).alias("p"))
    return p.select("cluster", F.substring_index("p", ":", 1).alias("source"), F.expr("substr(p, instr(p, ':') + 1)").alias("source_id"))


def policy_in_text(spark: SparkSession, path: str) -> DataFrame:
    """The first fenced JSON block of a text that holds ``attribution``: one row per source."""
    text = spark.read.text(path, wholetext=True)
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)```json\s*(.*?)```"), 1)
    block = text.select(F.get(F.filter(blocks, lambda b: b.contains('"attribution"')), F.lit(0)).alias("b"))
    m = block.select(F.explode(F.from_json("b", "attribution map<string,struct<label:string,url_template:string,hosts:array<string>,license:string>>")["attribution"]).alias("source", "p"))
    return m.select("source", "p.*")


def vocabulary(spark: SparkSession, path: str, axis: str) -> DataFrame:
    """(key, label) of one axis of a vocabulary file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"struct<{axis}:map<string,struct<label:string>>>")[axis]).alias("key", "v")).select("key", "v.label")


def marc_xml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """MARC records: id, title with subtitle, first author, year, language, with the usual precedence of fields."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema("controlfield array<struct<_tag:string,_VALUE:string>>, datafield array<struct<_tag:string,subfield:array<struct<_code:string,_VALUE:string>>>>").load(path)

    def sub(tag: str, code: str) -> Column:
        return F.expr(f"get(transform(filter(datafield, d -> d._tag = '{tag}'), d -> get(filter(d.subfield, s -> s._code = '{code}'), 0)._VALUE), 0)")

    title = F.concat_ws(": ", F.regexp_replace(sub("245", "a"), r"\s*[/:]\s*$", ""), F.regexp_replace(sub("245", "b"), r"\s*[/:]\s*$", ""))
    return raw.select(
        F.expr("get(filter(controlfield, c -> c._tag = '001'), 0)._VALUE").alias("source_id"), title.alias("title"), F.coalesce(sub("100", "a"), sub("700", "a")).alias("author"),
        F.coalesce(F.regexp_extract(F.coalesce(sub("264", "c"), sub("260", "c")), r"([0-9]{4})", 1).try_cast("int")).alias("year"), sub("041", "a").alias("language"),
    )


_CELL = r"(?is)<t[hd][^>]*>\s*(.*?)\s*</t[hd]>\s*<td[^>]*>\s*(.*?)\s*</td>"


def label_cells(html: Column) -> Column:
    """map label -> text of the two-column tables of a page; the first cell of a label wins."""
    labels = F.regexp_extract_all(html, F.lit(_CELL), 1)
    cells = F.regexp_extract_all(html, F.lit(_CELL), 2)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    pairs = F.arrays_zip(F.transform(labels, lambda x: F.regexp_replace(clean(x), ":$", "")).alias("k"), F.transform(cells, clean).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def select_options(html: Column, name: str) -> Column:
    """array<struct<value,label>> of a form's select."""
    block = F.regexp_extract(html, rf"(?is)<select[^>]*name=[\"']{re.escape(name)}[\"'][^>]*>(.*?)</select>", 1)
    v, l = (F.regexp_extract_all(block, F.lit(r"(?is)<option[^>]*value=[\"']([^\"']*)[\"'][^>]*>\s*(.*?)\s*</option>"), i) for i in (1, 2))
    return F.arrays_zip(v.alias("value"), l.alias("label"))


def parse_policy_block(text: str) -> dict:
    """The policy of one text on the driver, checked: every source has a label and a list of hosts."""
    for block in re.findall(r"```json\s*(.*?)```", text, re.S):
        data = json.loads(block)
        if "attribution" in data:
            for source, p in data["attribution"].items():
                if not p.get("label") or not isinstance(p.get("hosts"), list):
                    raise ValueError(f"policy of {source} is incomplete")
            return data
    raise ValueError("no policy block")
