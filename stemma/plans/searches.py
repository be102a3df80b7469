"""Search, vocabulary channel, facets, topic tree and density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes
from stemma.operators import search as so
from stemma.operators import tags, tree
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

CONJUNCTIVE = "image god"
RELAXED = "catenae hymnum providence martyrdom zzyzx"
PHRASE = '"free will" -martyrdom'
FIELDED = "lang:en year:1990-2010 -in:quaderni letters"


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", "container", F.col("pub_year").alias("year"), F.col("lang"), "source", "doc_kind")
    return so.documents(t, ["text", "container"])


_DOCS = f"(select doc_id, pub_year as year, lang, container, source, doc_kind, {S.fold(chr(39) + chr(39) + ' || concat_ws(chr(32), text, container)')} as hay from documents)"


def _hit(term: str) -> str:
    return f"cast(regexp_matches(hay, '(^|[^0-9a-z''])' || '{term}') as int)"


def _verdict_sql(text: str, where: str = "true") -> str:
    q = so.parse(text)
    n = len(q.terms)
    hits = ", ".join(f"{_hit(t)} as h{i}" for i, t in enumerate(q.terms))
    score = " + ".join(f"h{i}" for i in range(n))
    depth = "case " + " ".join(f"when count(*) filter (where score >= {k}) >= {so.WIDEN_FLOOR} then {k}" for k in range(n, 1, -1)) + " when count(*) > 0 then 1 else 0 end" if n > 1 else "case when count(*) > 0 then 1 else 0 end"
    absent = " || ".join(f"case when coalesce(max(h{i}), 0) = 0 then '{t} ' else '' end" for i, t in enumerate(q.terms))
    return f"""with s as (select *, {score} as score from (select doc_id, {hits} from {_DOCS} where {where})), m as (select * from s where score > 0),
      dp as (select {depth} as depth from m)
    select cast(count(*) filter (where score >= {n}) as bigint) as carrying_all_terms, cast(count(*) filter (where score >= depth) as bigint) as listed, any_value(depth) as hit_depth, any_value(depth) < {n} and count(*) > 0 as widened, trim({absent}) as absent from dp left join m on true"""


def _verdict(spark: SparkSession, d: str, text: str) -> DataFrame:
    v = so.search(documents(spark, d), text)
    return spark.createDataFrame([(v.carrying_all_terms, v.listed, v.hit_depth, v.widened, " ".join(v.absent))], "carrying_all_terms bigint, listed bigint, hit_depth int, widened boolean, absent string")


@query(_verdict_sql(RELAXED))
def search_verdict(spark: SparkSession, d: str) -> DataFrame:
    """All figures of a query that has to be widened."""
    return _verdict(spark, d, RELAXED)


@query(_verdict_sql(CONJUNCTIVE))
def search_conjunctive(spark: SparkSession, d: str) -> DataFrame:
    return _verdict(spark, d, CONJUNCTIVE)


def _scores_sql(text: str, where: str) -> str:
    q = so.parse(text)
    score = " + ".join(_hit(t) for t in q.terms) if q.terms else "1"
    return f"select doc_id, score from (select doc_id, {score} as score from {_DOCS} where {where}) where score > 0"


@query(_scores_sql(RELAXED, "true"))
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    return so.scored(documents(spark, d), RELAXED).select("doc_id", "score")


@query(_scores_sql(PHRASE, "contains(hay, 'free will') and not regexp_matches(hay, '(^|[^0-9a-z''])martyrdom')"))
def search_phrase_exclude(spark: SparkSession, d: str) -> DataFrame:
    return so.scored(documents(spark, d), PHRASE).select("doc_id", "score")


@query(_scores_sql(FIELDED, f"coalesce(regexp_matches({S.fold('lang')}, '(^|[^0-9a-z''])en'), false) and coalesce(year between 1990 and 2010, false) and not coalesce(regexp_matches({S.fold('container')}, '(^|[^0-9a-z''])quaderni'), false)"))
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    return so.scored(documents(spark, d), FIELDED).select("doc_id", "score")


@query(f"""select doc_id, score from (select doc_id, year, {' + '.join(_hit(t) for t in so.parse(RELAXED).terms)} as score from {_DOCS}) where score > 0 order by score desc, year desc nulls last, doc_id limit 25""")
def search_top_hits(spark: SparkSession, d: str) -> DataFrame:
    return so.ordered(so.scored(documents(spark, d), RELAXED), limit=25).select("doc_id", "score")


HEADING = "divine pedagogy"
_TAGGED = f"(select c.record_id as doc_id, c.title, c.year, c.language as lang, l.themes, l.works, l.approaches, l.relevance, l.needs_review from {S.CURRENT} c join {S.LATEST} l using (notice_id))"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", "themes", "works", "approaches", "relevance", "needs_review")
    return current(spark, d, "title", "year", "language").join(t, "notice_id").withColumnRenamed("record_id", "doc_id").withColumnRenamed("language", "lang")


@query(f"""select doc_id, hits > 0 as textual, vocab_hit from (select doc_id, {_hit('divine')} + {_hit('pedagogy')} as hits, regexp_matches(vocab, '(^|[^0-9a-z''])divine pedagogy([^0-9a-z'']|$)') as vocab_hit
    from (select doc_id, {S.fold("coalesce(title, '')")} as hay, {S.fold("array_to_string(themes, ' · ')")} as vocab from {_TAGGED})) where hits > 0 or vocab_hit""")
def vocab_channel(spark: SparkSession, d: str) -> DataFrame:
    """Records reached by a heading are listed; those without a textual hit are told apart."""
    docs = so.documents(tagged(spark, d), ["title"], F.array_join("themes", " · "))
    return so.scored(docs, HEADING).select("doc_id", (F.col("score") > 0).alias("textual"), "vocab_hit")


@query(f"select doc_id from {_TAGGED} where len(list_filter(themes, lambda t: starts_with({S.fold('t')}, 'pray'))) > 0 and not len(list_filter(works, lambda w: starts_with({S.fold('w')}, 'contra'))) > 0 and coalesce(year >= 1980, false)")
def search_vocabulary_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = so.documents(tagged(spark, d), ["title"])
    return so.scored(docs, "theme:pray -work:contra year:>=1980").select("doc_id")


@query(f"select doc_id from {_TAGGED} where list_has_any(themes, ['prayer', 'kenosis', 'asceticism']) and list_has_any(approaches, ['history', 'philology']) and relevance in ('core', 'partial')")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Four questions: any answer inside one, all of them together."""
    t = tagged(spark, d)
    anyof = lambda c, vals: F.arrays_overlap(c, F.array(*map(F.lit, vals)))
    return t.where(anyof("themes", ["prayer", "kenosis", "asceticism"]) & anyof("approaches", ["history", "philology"]) & F.col("relevance").isin("core", "partial")).select("doc_id")


# ---------------------------------------------------------------- topic tree
_PUB = f"(select c.notice_id, c.year, c.language, l.relevance, l.needs_review, l.themes, l.works from {S.CURRENT} c join {S.LATEST} l using (notice_id) where l.relevance in ('core', 'partial', 'marginal'))"
_BRIDGE = f"""(with p as {_PUB}, b as (select 'theme/' || t as node_id, 'root/themes' as parent_id, 2 as depth, notice_id from (select distinct notice_id, unnest(themes) as t from p)
    union all select 'work/' || w, 'root/works', 2, notice_id from (select distinct notice_id, unnest(works) as w from p)) select * from b union all select distinct parent_id, 'root', 1, notice_id from b)"""


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = tags.latest(table(spark, d, "tag_log")).where(tags.relevance_at_least(F.col("relevance"), "marginal")).select("notice_id", "relevance", "needs_review", "themes", "works")
    p = current(spark, d, "year", "language").join(p, "notice_id")
    return tree.bridge(p), p


@query(f"""select b.node_id, b.parent_id, b.depth, count(*) as n_notices, min(p.year) as min_year, max(p.year) as max_year, count(*) filter (where p.needs_review) as in_review,
    count(*) filter (where relevance = 'core') as n_core, count(*) filter (where relevance = 'partial') as n_partial, count(*) filter (where relevance = 'marginal') as n_marginal from {_BRIDGE} b join {_PUB} p using (notice_id) group by 1, 2, 3""")
def tree_node_stats(spark: SparkSession, d: str) -> DataFrame:
    return tree.node_stats(*_tree(spark, d))


@query(f"""with c as (select b.node_id, p.language, count(*) as n from {_BRIDGE} b join {_PUB} p using (notice_id) where p.language is not null group by 1, 2), r as (select *, row_number() over (partition by node_id order by n desc, language) as k from c)
    select node_id, string_agg(language || ' ' || n, ', ' order by k) as top from r where k <= 3 group by 1""")
def tree_summaries(spark: SparkSession, d: str) -> DataFrame:
    b, p = _tree(spark, d)
    return tree.top_values(b, p, "language", 3)


_QUESTION = "divine pedagogy and prayer"
_NODES = f"(select node_id, count(*) as n_notices from {_BRIDGE} where depth = 2 group by 1)"
_HITS = " + ".join(f"cast(regexp_matches({S.fold('node_id')}, '\\b{t}') as int)" for t in tree.question_terms(_QUESTION))


@query(f"select node_id, n_notices, {_HITS} as hits from {_NODES} where {_HITS} > 0 order by hits desc, n_notices desc, node_id limit 8")
def density_nodes(spark: SparkSession, d: str) -> DataFrame:
    b, _ = _tree(spark, d)
    nodes = b.where("depth = 2").groupBy("node_id").agg(F.count("*").alias("n_notices"))
    return tree.select_nodes(nodes, _QUESTION, "node_id").select("node_id", "n_notices", "hits")


@query(f"""with n as (select node_id from (select node_id, n_notices, {_HITS} as hits from {_NODES}) where hits > 0 order by hits desc, n_notices desc, node_id limit 8)
    select count(distinct notice_id) as notices, (select count(*) from {_PUB}) as indexed from {_BRIDGE} where node_id in (select node_id from n)""")
def density_union(spark: SparkSession, d: str) -> DataFrame:
    b, p = _tree(spark, d)
    nodes = b.where("depth = 2").groupBy("node_id").agg(F.count("*").alias("n_notices"))
    return tree.density(b, tree.select_nodes(nodes, _QUESTION, "node_id"), p.count())


@query("select cast(0 as bigint) as notices, cast(0 as bigint) as indexed where true")
def density_no_match(spark: SparkSession, d: str) -> DataFrame:
    """No node has a word of the question: nothing is selected, and the density is 0."""
    b, _ = _tree(spark, d)
    nodes = b.where("depth = 2").groupBy("node_id").agg(F.count("*").alias("n_notices"))
    return tree.density(b, tree.select_nodes(nodes, "zzzzyyyyxxxx", "node_id"), 0)


@query(f"""select theme, decade, count(*) as n from (select unnest(list_distinct(themes)) as theme, {S.decade('year')} as decade from {_PUB} where relevance in ('core', 'partial')) group by 1, 2""")
def density_by_heading(spark: SparkSession, d: str) -> DataFrame:
    _, p = _tree(spark, d)
    return p.where(F.col("relevance").isin("core", "partial")).select(F.explode(F.array_distinct("themes")).alias("theme"), codes.decade(F.col("year")).alias("decade")).groupBy("theme", "decade").agg(F.count("*").alias("n"))


@query("select doc_id, record_id, n from (select a.doc_id, a.record_id, count(b.doc_id) as n from documents a join documents b on a.record_id = b.record_id and a.doc_id <> b.doc_id group by 1, 2)")
def record_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Documents about one record: how many others each has."""
    t = table(spark, d, "documents").where("record_id is not null").select("doc_id", "record_id")
    n = t.groupBy("record_id").agg((F.count("*") - 1).alias("n")).where("n > 0")
    return t.join(n, "record_id").select("doc_id", "record_id", "n")
