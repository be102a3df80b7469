"""The questions a reader asks, as methods that return DataFrames or verdicts.

    e = Engine(spark, "/data")
    e.search("author:lindqvist prayer").sentence()
    e.density("divine pedagogy")
    e.stats()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes
from stemma.operators import search as so
from stemma.operators import stats, tags, tree
from stemma.plans.base import current
from stemma.session import table

MAX_LIMIT = 500


class Engine:
    """Search, gap, record, vocabulary, density, stats, coverage and neighbourhood over one data folder.

    A published figure counts core and partial records only; marginal ones are listed
    and never counted; none and untagged ones are not part of the answer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        t = tags.latest(table(spark, folder, "tag_log")).select("notice_id", "relevance", "needs_review", "works", "themes", "approaches", "vocabulary_version", "prompt_version")
        c = current(spark, folder, "title", "authors", "year", "language", "type", "container", "abstract")
        self.records = c.join(t, "notice_id").where(tags.relevance_at_least(F.col("relevance"), "marginal")).select(
            "notice_id", "title", F.col("authors.name").alias("authors"), "year", codes.norm_lang(F.col("language")).alias("lang"), codes.norm_type(F.col("type")).alias("type"), "container", "abstract", "relevance", "needs_review", "works", "themes", "approaches",
            F.array_distinct(F.transform("themes", lambda x: F.substring_index(x, ".", 1))).alias("domains"), F.col("relevance").isin(*tags.COUNTED).alias("counts"),
        )
        self.docs = so.documents(self.records, ["title", "authors", "container", "year", "themes", "abstract"], F.concat_ws(" · ", "themes", "works"))

    def search(self, query: str, lang: str | None = None, since: int | None = None, until: int | None = None) -> so.Verdict:
        d = self.docs
        if lang:
            d = d.where(F.col("lang") == lang)
        if since is not None:
            d = d.where(F.col("year") >= since)
        if until is not None:
            d = d.where(F.col("year") <= until)
        return so.search(d, query, counts=F.col("counts"))

    def hits(self, query: str, limit: int = 50, offset: int = 0, **where) -> DataFrame:
        """One page of hits by score, year and id; at most 500 rows."""
        v = self.search(query, **where)
        return so.ordered(v.hits, tie="notice_id").offset(offset).limit(min(limit, MAX_LIMIT)).select("notice_id", "title", "authors", "year", "lang", "type", "container", "relevance", "score", "vocab_only")

    def gap(self, query: str) -> dict:
        """What a query does not find: the figures of the whole query, terms never found, and what widening lists."""
        v = self.search(query)
        return {"carrying_all_terms": v.carrying_all_terms, "listed": v.listed, "counted": v.counted, "absent": v.absent, "widened": v.widened, "sentence": v.sentence()}

    def record(self, notice_id: str) -> DataFrame:
        return self.records.where(F.col("notice_id") == notice_id)

    def vocabulary(self) -> DataFrame:
        """(axis, term, counted, mentioned)."""
        axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("terms")) for a in ("works", "themes", "approaches")]))
        t = self.records.select("counts", axes.alias("x")).select("counts", "x.axis", F.explode("x.terms").alias("term"))
        return t.groupBy("axis", "term").agg(F.count_if("counts").alias("counted"), F.count_if(~F.col("counts")).alias("mentioned"))

    def density(self, question: str, most: int = tree.MAX_NODES, select=None) -> dict:
        """Distinct notices of the nodes a question selects beside all that are indexed; nothing selected is 0.

        ``select(nodes, question, most)`` may choose the nodes instead of the words of the question;
        what it names that is no node is left out, and the answer says that a selector chose.
        """
        b = tree.bridge(self.records.where("counts"))
        nodes = b.where("depth = 2").groupBy("node_id").agg(F.count("*").alias("n_notices"))
        chosen = tree.select_nodes(nodes, question, "node_id", most=most) if select is None else nodes.join(select(nodes, question, most).select("node_id").distinct(), "node_id", "left_semi").orderBy("node_id").limit(most)
        r = tree.density(b, chosen, self.records.where("counts").count()).first()
        return {"nodes": [x["node_id"] for x in chosen.collect()], "notices": r["notices"], "indexed": r["indexed"], "parameters": {"min_relevance": "partial", "max_nodes": most, "engine": "deterministic" if select is None else "selector"}}

    def neighborhood(self, question: str, limit: int = 50) -> DataFrame:
        """The notices of the selected nodes, each once."""
        b = tree.bridge(self.records)
        nodes = b.where("depth = 2").groupBy("node_id").agg(F.count("*").alias("n_notices"))
        chosen = tree.select_nodes(nodes, question, "node_id").select("node_id")
        ids = b.join(F.broadcast(chosen), "node_id", "left_semi").select("notice_id").distinct()  # at most MAX_NODES nodes
        return self.records.join(ids, "notice_id", "left_semi").orderBy(F.col("year").desc_nulls_last(), "notice_id").limit(min(limit, MAX_LIMIT))

    def stats(self) -> DataFrame:
        return self.records.groupBy(codes.decade(F.col("year")).alias("decade"), "lang").agg(F.count_if("counts").alias("counted"), F.count_if(~F.col("counts")).alias("mentioned"))

    def coverage(self) -> DataFrame:
        """How many records have an abstract, over decade, language and type and as a whole."""
        r = self.records.where("counts").withColumn("decade", codes.decade(F.col("year")))
        return stats.coverage(r, ["decade", "lang", "type"], F.col("abstract").isNotNull())

    def primary(self) -> DataFrame:
        """The layer of texts by the subject: listed, never counted."""
        by = current(self.spark, self.folder, "relation", "title", "year").where("relation = 'by'")
        return by.select("notice_id", "title", "year")
