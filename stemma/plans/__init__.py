"""Registered queries of the core operators, with the SQL each is checked against."""

from __future__ import annotations

from stemma.plans import counts, deeper, linked, logs, more, ranks, searches, texts

MODULES = (texts, counts, logs, ranks, searches, linked, more, deeper)
QUERIES: dict = {}
SQL: dict = {}
for _m in MODULES:
    if QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"queries registered twice: {QUERIES.keys() & _m.QUERIES.keys()}")
    QUERIES.update(_m.QUERIES)
    SQL.update(_m.SQL)
