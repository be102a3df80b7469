"""Token counts of whole texts under a public tokenizer whose path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = os.environ.get("STEMMA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces of very long texts are tokenized apart at white space from this many characters on
PIECE = 200_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text; 0 for null and empty texts."""
    if not text:
        return 0
    enc = encoding(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(id, keep..., tokens): one row per input row; the text does not leave the first stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([count(t, path) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "tokens"])

    cols = docs.select(id_col, *keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]) + ", tokens bigint"
    return cols.mapInArrow(run, schema)
