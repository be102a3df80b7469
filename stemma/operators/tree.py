"""The topic tree as node and bridge tables, its statistics, and neighbourhood density."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import fold

MAX_NODES = 8
# Words of a question that name nothing.
QUESTION_STOP = (
    "about after against among around because before between could during every 从 from have into notice notices "
    "other over project research should since some such than that their them then there these they this "
    "those through under very were what when where which while with within would dans avec pour leur leurs "
    "cette comme plus sont être etre chez sur les des und der die das von mit auf für fur eine einen"
).split()


def bridge(tagged: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth, axis, notice_id): theme leaves under their domain and works, a notice under each of its own."""
    t = tagged.select("notice_id", F.explode(F.array_distinct("themes")).alias("leaf"))
    leaf = t.select(F.concat(F.lit("theme/"), "leaf").alias("node_id"), F.lit("root/themes").alias("parent_id"), F.lit(2).alias("depth"), F.lit("themes").alias("axis"), "notice_id")
    w = tagged.select("notice_id", F.explode(F.array_distinct("works")).alias("work"))
    work = w.select(F.concat(F.lit("work/"), "work").alias("node_id"), F.lit("root/works").alias("parent_id"), F.lit(2).alias("depth"), F.lit("works").alias("axis"), "notice_id")
    both = leaf.unionByName(work)
    top = both.select(F.col("parent_id").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("depth"), "axis", "notice_id").distinct()
    return both.unionByName(top)


def node_stats(b: DataFrame, notices: DataFrame) -> DataFrame:
    """Per node: notices, years, share in review, confidence in thousandths, counts by language and relevance."""
    j = b.join(notices, "notice_id")
    return j.groupBy("node_id", "parent_id", "depth").agg(
        F.count("*").alias("n_notices"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_if("needs_review").alias("in_review"),
        F.count_if(F.col("relevance") == "core").alias("n_core"), F.count_if(F.col("relevance") == "partial").alias("n_partial"), F.count_if(F.col("relevance") == "marginal").alias("n_marginal"),
    )


def top_values(b: DataFrame, notices: DataFrame, value: str, k: int) -> DataFrame:
    """(node_id, top): the k most frequent values per node with their counts; ties go to the lesser value."""
    c = b.join(notices.select("notice_id", value), "notice_id").where(F.col(value).isNotNull()).groupBy("node_id", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("node_id").orderBy(F.col("n").desc(), value)
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", value, "n"))), lambda x: F.concat(x[value], F.lit(" "), x["n"].cast("string"))), ", ").alias("top"))


def histograms(b: DataFrame, notices: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(node_id, kind, value, n): how often a node has each value of the columns; what stands for null is given with them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit(missing)).alias("value")) for c, missing in columns.items()]))
    return b.select("node_id", "notice_id").join(notices.select("notice_id", *columns), "notice_id").select("node_id", pairs.alias("p")).groupBy("node_id", "p.kind", "p.value").agg(F.count("*").alias("n"))


def mean_confidence(b: DataFrame, notices: DataFrame) -> DataFrame:
    """(node_id, n, mean_confidence): whole thousandths, so that the mean does not depend on the order of rows; unknown counts as 0."""
    t = notices.select("notice_id", F.round(F.coalesce("confidence", F.lit(0.0)) * 1000).cast("bigint").alias("t"))
    return b.select("node_id", "notice_id").join(t, "notice_id").groupBy("node_id").agg(F.count("*").alias("n"), F.sum("t").alias("t")).select("node_id", "n", F.expr("t div n").alias("mean_confidence"))


def entity_tags(b: DataFrame, notices: DataFrame, works: int = 4, limit: int = 8) -> DataFrame:
    """(node_id, kind, value, rank): the works met most often at a node and, up to ``limit`` in all, the authors; ties go to the lesser name."""

    def ranked(column: str, kind: str) -> DataFrame:
        v = notices.select("notice_id", F.explode(F.array_distinct(column)).alias("value")).where("value != 'unspecified' and value != ''")
        n = b.select("node_id", "notice_id").join(v, "notice_id").groupBy("node_id", "value").agg(F.count("*").alias("n"))
        w = Window.partitionBy("node_id").orderBy(F.col("n").desc(), "value")
        return n.select("node_id", F.lit(kind).alias("kind"), "value", F.row_number().over(w).alias("rank"))

    top = ranked("works", "work").where(F.col("rank") <= works)
    taken = top.groupBy("node_id").agg(F.count("*").alias("c"))
    names = ranked("surnames", "author").join(taken, "node_id", "left").where(F.col("rank") <= limit - F.coalesce("c", F.lit(0))).drop("c")
    return top.unionByName(names)


def question_terms(question: str, subject: tuple[str, ...] = ()) -> list[str]:
    """Words of any script with four letters or more that are neither numbers nor stop words nor names of the ``subject`` of all nodes."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", question.casefold()) if not unicodedata.combining(c))
    return [w for w in dict.fromkeys(re.findall(r"\w+", plain)) if len(w) > 3 and not w.isdigit() and w not in QUESTION_STOP and w not in subject]


def select_nodes(nodes: DataFrame, question: str, text: str = "label", size: str = "n_notices", most: int = MAX_NODES) -> DataFrame:
    """Nodes whose text has a term at a word start, by hits then size; nothing when no node has one."""
    terms = question_terms(question)
    if not terms:
        return nodes.where(F.lit(False)).withColumn("hits", F.lit(0))
    t = fold(F.col(text))
    hits = sum((t.rlike(r"(?U)\b" + re.escape(w)).cast("int") for w in terms), F.lit(0))
    return nodes.where(F.col(size) > 0).withColumn("hits", hits).where("hits > 0").orderBy(F.col("hits").desc(), F.col(size).desc(), "node_id").limit(most)


def density(b: DataFrame, selected: DataFrame, indexed: int) -> DataFrame:
    """(notices, indexed): distinct notices of the selected nodes beside all that are indexed; 0 for no node."""
    return b.join(F.broadcast(selected.select("node_id")), "node_id", "left_semi").agg(F.count_distinct("notice_id").alias("notices")).withColumn("indexed", F.lit(indexed).cast("bigint"))  # at most MAX_NODES nodes
