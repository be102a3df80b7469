"""Garbled text from a wrong character encoding, over whole tables.

Method: the best-first search of :mod:`stemma.llm.encoding` over encode, decode
and unescape steps.  Texts that are plain ASCII without an entity never leave the
JVM.  One pass, no shuffle.

Defined cases: null texts are no case; a text with U+FFFD is a case that is not
restored in whole; a text whose words are only partly garbled is restored word by
word; repeated rows are cases each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.encoding import repair

_WORTH = r"[^\x00-\x7F]|&#?\w+;"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        cols = batch.to_pydict()
        for rid, *texts in zip(cols["record_id"], cols["title"], cols["abstract"]):
            for field, text in zip(("title", "abstract"), texts):
                if text:
                    new, garbled, whole = repair(text)
                    if garbled:
                        for c, v in zip(out, (rid, field, text, new, whole)):
                            c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:4]), pa.array(out[4], pa.bool_())], names=["record_id", "field", "garbled", "restored", "whole"])


def restored(corpus: DataFrame) -> DataFrame:
    """(record_id, field, garbled, restored, whole) of the garbled titles and abstracts."""
    worth = lambda c: F.when(F.col(c).rlike(_WORTH), F.col(c)).alias(c)
    df = corpus.select("record_id", worth("title"), worth("abstract")).where("title is not null or abstract is not null")
    return df.mapInArrow(_restore, "record_id bigint, field string, garbled string, restored string, whole boolean")


def found(corpus: DataFrame) -> DataFrame:
    """(record_id, field) of the garbled titles and abstracts."""
    return restored(corpus).select("record_id", "field").distinct()
