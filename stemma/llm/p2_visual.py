"""Visually identical text with different characters, over whole tables.

Method: the compiled longest-match transducer of :mod:`stemma.llm.visual`, which
reads every text once, grapheme cluster by grapheme cluster.  Values that are
ASCII never leave the JVM: only rows with another character go to Python.  Words
that are garbled (another problem) are stepped over.

Defined cases: null fields and null names give no case and a null form; a row
counts once per field, however many of its names are cases; repeated rows give
one case per row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.encoding import repair
from stemma.llm.visual import TRANSDUCER

_NOT_ASCII = r"[^\x00-\x7F]"


def form_of(text: str | None) -> tuple[str | None, bool]:
    """(consistent form, is it a case?); garbled words stay as they are."""
    if not text or text.isascii():
        return text, False
    words: set[str] = set()
    garbled = repair(text, words)[1]
    out, kinds = TRANSDUCER.form(text, words.__contains__ if garbled else None)
    return out, bool(kinds)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fields = [], []
        cols = batch.to_pydict()
        for rid, title, names in zip(cols["record_id"], cols["title"], cols["names"]):
            if title and form_of(title)[1]:
                ids.append(rid)
                fields.append("title")
            if names and any(n and form_of(n)[1] for n in names):
                ids.append(rid)
                fields.append("authors")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string())], names=["record_id", "field"])


def found(corpus: DataFrame) -> DataFrame:
    """(record_id, field) of the fields with a place that isn't written as it reads."""
    names = F.expr("filter(transform(authors, x -> x.name), x -> x rlike '[^\\\\x00-\\\\x7F]')")
    df = corpus.select("record_id", F.when(F.col("title").rlike(_NOT_ASCII), F.col("title")).alias("title"), names.alias("names"))
    return df.where("title is not null or size(names) > 0").mapInArrow(_found, "record_id bigint, field string").distinct()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, cases = [], []
        for v in batch.column(3).to_pylist():
            f, c = form_of(v)
            forms.append(f)
            cases.append(c)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(forms, pa.string()), pa.array(cases, pa.bool_())], names=["record_id", "field", "pos", "form", "changed"])


def canonical_forms(corpus: DataFrame) -> DataFrame:
    """One consistent form of every title (pos 0) and every author name (pos from 0).

    The title is null where the row has none; null names keep their position.
    """
    base = corpus.select("record_id", "title", F.col("authors.name").alias("names"))
    t = base.select("record_id", F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value"))
    n = base.select("record_id", F.lit("authors").alias("field"), F.posexplode("names").alias("pos", "value"))
    values = t.unionByName(n)
    # SQL keeps plain ASCII values in the JVM
    odd = values.where(F.col("value").rlike(_NOT_ASCII)).mapInArrow(_forms, "record_id bigint, field string, pos int, form string, changed boolean")
    plain = values.where("value is null").unionByName(values.where(F.col("value").isNotNull() & ~F.col("value").rlike(_NOT_ASCII)))
    return odd.unionByName(plain.select("record_id", "field", "pos", F.col("value").alias("form"), F.lit(False).alias("changed")))
