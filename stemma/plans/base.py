"""Views that the plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.session import table


def notice_id() -> F.Column:
    return F.concat("source", F.lit(":"), "source_id")


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last delivery of every notice; only the listed columns are read."""
    c = table(spark, d, "corpus").select("record_id", "source", "source_id", *columns).withColumn("notice_id", notice_id())
    rest = [x for x in c.columns if x != "notice_id"]
    g = c.groupBy("notice_id").agg(F.max_by(F.struct(*rest), "record_id").alias("r"))
    return g.select("notice_id", "r.*")


def register(queries: dict, sql: dict):
    """Decorator: a query under its function's name, with its SQL."""

    def with_sql(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return put

    return with_sql
