"""Command line: ``python -m stemma QUESTION [words] --data DIR [--json]``.

search, gap, record, vocabulary, density, neighborhood, stats, coverage and primary ask
what the methods of :class:`stemma.engine.Engine` answer, as text or as JSON lines.
An unknown question or a question without words where it needs some ends with status 2.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

WORDY = ("search", "gap", "record", "density", "neighborhood")
PLAIN = ("vocabulary", "stats", "coverage", "primary")


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="stemma", description="Ask a bibliography.")
    p.add_argument("question", choices=WORDY + PLAIN)
    p.add_argument("words", nargs="*", help="the query, or the id of a record")
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--json", action="store_true", help="one JSON object a line")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--lang")
    p.add_argument("--since", type=int)
    p.add_argument("--until", type=int)
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    if a.question in WORDY and not a.words:
        p.error(f"{a.question} needs words")
    return a


def answer(engine, a: argparse.Namespace) -> list[dict]:
    """The answer as plain objects; tables give at most ``limit`` rows."""
    words = " ".join(a.words)
    rows = lambda df: [json.loads(r) for r in df.limit(min(a.limit, 500)).toJSON().collect()]
    if a.question == "search":
        where = {k: getattr(a, k) for k in ("lang", "since", "until")}
        v = engine.search(words, **where)
        head = {"listed": v.listed, "counted": v.counted, "carrying_all_terms": v.carrying_all_terms, "widened": v.widened, "absent": v.absent, "sentence": v.sentence()}
        return [head, *rows(engine.hits(words, limit=a.limit, offset=a.offset, **where))]
    got = getattr(engine, a.question)(words) if a.question in WORDY else getattr(engine, a.question)()
    return rows(got) if isinstance(got, DataFrame) else [got]


def main(argv: list[str] | None = None, engine=None) -> int:
    a = _arguments(argv)
    if engine is None:
        from stemma.engine import Engine
        from stemma.session import get_spark

        spark = get_spark(a.master)
        spark.sparkContext.setLogLevel("ERROR")
        engine = Engine(spark, a.data)
    for row in answer(engine, a):
        print(json.dumps(row, ensure_ascii=False) if a.json else "  ".join(f"{k}: {v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
