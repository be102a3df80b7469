"""A paged connector on Spark's Python Data Source API.

A harvest is a source whose partitions are slices (a year, a query) and whose pages
follow a cursor, an offset or a token.  ``fetch`` is injected, so that nothing here
opens a connection: in tests it reads prepared pages.  Retries honour Retry-After up
to an hour; a dead token starts its slice over once, and a second death is an error.  As a
stream, every batch is one page of each slice and the offset is the cursor.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAX_WAIT = 3600


def retry_after(header: str | None) -> int | None:
    """Seconds to wait, at most an hour; null for none or what is no number."""
    if header is None:
        return None
    try:
        return min(MAX_WAIT, max(0, int(header.strip())))
    except ValueError:
        return None


class DeadToken(Exception):
    """The service no longer knows the token of the next page."""


def walk(fetch: Callable[[str, str | None], dict], slice_: str, cap: int | None = None, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of all pages of a slice: ``fetch(slice, token) -> {rows, next, status, retry_after}``."""
    token, given, restarted, tries = None, 0, False, 0
    seen: set[str] = set()
    while True:
        try:
            page = fetch(slice_, token)
        except DeadToken:
            if restarted:
                raise RuntimeError(f"{slice_}: the token died again after {given} rows; the slice is not whole") from None
            restarted, token = True, None
            continue
        if page.get("status", 200) in (429, 503):
            tries += 1
            if tries >= attempts:
                raise RuntimeError(f"{slice_}: no answer after {attempts} attempts")
            sleep(retry_after(page.get("retry_after")) or 1)
            continue
        tries = 0
        for row in page["rows"]:
            if row["source_id"] in seen:
                continue
            seen.add(row["source_id"])
            yield row
            given += 1
            if cap and given >= cap:
                return
        token = page.get("next")
        if not token:
            return


class _Slice(InputPartition):
    def __init__(self, value: str):
        self.value = value


def _fetcher(options: dict) -> Callable[[str, str | None], dict]:
    """The fetch that the options name: ``fetch`` is ``module:function``, called with (slice, token, options); else prepared
    pages are read from ``folder``, which all executors must share."""
    named = options.get("fetch")
    if named:
        module, _, function = named.partition(":")
        call = getattr(importlib.import_module(module), function)
        return lambda slice_, token: call(slice_, token, options)

    def read(slice_: str, token: str | None) -> dict:
        with open(f"{options['folder']}/{slice_}-{token or '0'}.json", encoding="utf-8") as f:
            return json.load(f)

    return read


def _row(slice_: str, row: dict) -> tuple:
    return slice_, row["source_id"], row.get("title"), json.dumps(row, ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.slices = dict(options), json.loads(options["slices"])

    def partitions(self):
        return [_Slice(s) for s in self.slices]

    def read(self, partition):
        for row in walk(_fetcher(self.options), partition.value):
            yield _row(partition.value, row)


class _Stream(SimpleDataSourceStreamReader):
    """One page of every open slice per batch; the offset holds the next token of each slice, so a restart resumes at its cursor."""

    def __init__(self, options: dict):
        self.options, self.slices = dict(options), json.loads(options["slices"])

    def initialOffset(self) -> dict:
        return {"next": {s: "" for s in self.slices}}  # a slice that is done has none

    def _page(self, slice_: str, token: str) -> tuple[list[tuple], str | None]:
        page = _fetcher(self.options)(slice_, token or None)
        if page.get("status", 200) != 200:
            return [], token  # asked again in the next batch
        return [_row(slice_, r) for r in page["rows"]], page.get("next")

    def read(self, start: dict):
        rows: list[tuple] = []
        then: dict[str, str] = {}
        for s, token in start["next"].items():
            got, following = self._page(s, token)
            rows += got
            if following is not None and (following or token == ""):
                then[s] = following
        return iter(rows), {"next": then}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows: list[tuple] = []
        for s, token in start["next"].items():
            if end["next"].get(s) != token:
                rows += self._page(s, token)[0]
        return iter(rows)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("folder", ...).option("slices", '["2001", ...]')``, or ``readStream``.

    ``record`` is the whole row as JSON, for the mappers of :mod:`stemma.sources.mappers`.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "slice string, source_id string, title string, record string"

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)
