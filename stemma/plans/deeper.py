"""Tree aggregates, subject nodes, cluster mixes and re-derived projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, ids, text
from stemma.operators import gates, graph, joins, stats, tags, tree
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.plans.searches import _BRIDGE, _PUB
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


def _tree(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    t = tags.latest(table(spark, d, "tag_log")).where(tags.relevance_at_least(F.col("relevance"), "marginal")).select("notice_id", "relevance", "needs_review", "confidence", "themes", "works", "approaches")
    p = current(spark, d, "year", "language", *columns).join(t, "notice_id")
    return tree.bridge(p), p


@query(f"""with j as (select b.node_id, p.language, p.relevance from {_BRIDGE} b join {_PUB} p using (notice_id))
    select node_id, 'language' as kind, coalesce(language, 'unknown') as value, count(*) as n from j group by 1, 3
    union all select node_id, 'relevance', relevance, count(*) from j group by 1, 3""")
def tree_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Languages and relevance of every node, as counts."""
    b, p = _tree(spark, d)
    return tree.histograms(b, p, {"language": "unknown", "relevance": ""})


@query(f"""select node_id, count(*) as n, cast(sum(cast(round(coalesce(confidence, 0) * 1000) as bigint)) // count(*) as bigint) as mean_confidence
    from {_BRIDGE} b join (select p.*, l.confidence from {_PUB} p join {S.LATEST} l using (notice_id)) using (notice_id) group by 1""")
def tree_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of every node in thousandths, rounded down."""
    b, p = _tree(spark, d)
    return tree.mean_confidence(b, p)


_SURNAME = f"split_part({S.fold('a.name')}, ',', 1)"


@query(f"""with a as (select notice_id, trim({_SURNAME}) as name from (select notice_id, unnest(authors) as a from {S.CURRENT}) where contains(a.name, ',')),
    w as (select b.node_id, v as value, count(*) as n from {_BRIDGE} b join (select notice_id, unnest(list_distinct(works)) as v from {_PUB}) using (notice_id) where v <> 'unspecified' group by 1, 2),
    wr as (select *, row_number() over (partition by node_id order by n desc, value) as k from w),
    u as (select b.node_id, name as value, count(*) as n from {_BRIDGE} b join (select distinct notice_id, name from a where name <> '') using (notice_id) group by 1, 2),
    ur as (select *, row_number() over (partition by node_id order by n desc, value) as k from u),
    top as (select node_id, value, k from wr where k <= 4), room as (select node_id, count(*) as c from top group by 1)
    select node_id, 'work' as kind, value, k as rank from top
    union all select ur.node_id, 'author', ur.value, ur.k from ur left join room using (node_id) where ur.k <= 8 - coalesce(room.c, 0)""")
def tree_entity_tags(spark: SparkSession, d: str) -> DataFrame:
    """The four works and, up to eight names in all, the authors met most often at a node."""
    b, p = _tree(spark, d, "authors")
    inverted = F.filter("authors", lambda a: a["name"].contains(","))
    p = p.withColumn("surnames", F.array_distinct(F.filter(F.transform(inverted, lambda a: F.trim(F.substring_index(text.fold(a["name"]), ",", 1))), lambda n: n != "")))
    return tree.entity_tags(b, p)


@query(f"""with e as (select distinct notice_id as src, 'theme:' || t as dst from (select notice_id, unnest(themes) as t from {S.LATEST}) where t <> '')
    select src, dst, 'theme' as rel from e where dst in (select dst from e group by 1 having count(*) >= 3)""")
def graph_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Links of notices to subjects that three notices or more share."""
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", F.explode("themes").alias("theme"))
    return graph.edges(t, "notice_id", "theme", "theme", at_least=3)


@query()
def greedy_trails(spark: SparkSession, d: str) -> DataFrame:
    """Heaviest links first, three to an end at most; checked against a plain loop in tests."""
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", "themes")
    return graph.greedy_trails(graph.co_occurrence(t, "notice_id", "themes", 4))


@query(f"""with x as (select relevance, unnest([struct_pack(axis := 'works', v := works), struct_pack(axis := 'themes', v := themes), struct_pack(axis := 'approaches', v := approaches)]) as x from {S.LATEST} where relevance in ('core', 'partial', 'marginal')),
    o as (select relevance, x.axis as axis, unnest(list_distinct(x.v)) as option from x)
    select axis, option, count(*) as mentioned, count(*) filter (where relevance <> 'marginal') as counted, count(*) filter (where relevance <> 'marginal') = 0 as mentioned_only from o group by 1, 2""")
def mentioned_only(spark: SparkSession, d: str) -> DataFrame:
    """Options with the notices that mention and that count them; those that no counted notice has are marked."""
    t = tags.latest(table(spark, d, "tag_log")).where(tags.relevance_at_least(F.col("relevance"), "marginal"))
    return stats.options(t, ("works", "themes", "approaches"), F.col("relevance").isin(*tags.COUNTED))


@query(f"""with x as (select l.notice_id, case when l.relevance = 'none' then '(aside)' when len(coalesce(l.themes, [])) = 0 then '(no theme)' else l.themes[1] end as zone, l.relevance in ('core', 'partial') as counts, {S.norm_lang('c.language')} as lang
      from {S.CURRENT} c join {S.LATEST} l using (notice_id))
    select zone, lang, count(*) as n, count(*) filter (where counts or zone = '(aside)') as mixed, count(*) filter (where counts) as counted from x group by 1, 2""")
def cluster_mix(spark: SparkSession, d: str) -> DataFrame:
    """Where each notice is at home, with the languages of what the zone counts (of all it holds, for what is set aside)."""
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", "relevance", "themes")
    p = current(spark, d, "language").join(t, "notice_id")
    home = F.when(F.col("relevance") == "none", "(aside)").when(F.coalesce(F.size("themes"), F.lit(0)) < 1, "(no theme)").otherwise(F.get("themes", F.lit(0)))
    p = p.select(home.alias("zone"), codes.norm_lang(F.col("language")).alias("lang"), F.col("relevance").isin("core", "partial").alias("counts"))
    return p.groupBy("zone", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("counts") | (F.col("zone") == "(aside)")).alias("mixed"), F.count_if("counts").alias("counted"))


_KEYED = f"(select distinct {S.norm_doi('doi')} as doi, {S.norm_title('title')} as title_key, authors[1].name as author_key, {S.norm_type('type')} as type, year from corpus where doi is not null)"


@query(f"""with k as {_KEYED}, t as (select c.citation_id, c.run_id, c.cited_by_count as n, k.* from citations c join k using (doi) where c.count_method = 'title' and title_key <> '' and author_key is not null and type not in ('?', 'other') and year is not null),
    g as (select c.run_id, c.cited_by_count as n, k.* from citations c join k using (doi) where c.count_method = 'cluster' and c.measured),
    m as (select t.citation_id, count(g.n) as donors, count(g.n) filter (where g.n = t.n) as agreeing from t left join g on g.title_key = t.title_key and g.author_key = t.author_key and g.type = t.type and g.doi <> t.doi
      and abs(g.year - t.year) <= case when t.type in ('article', 'review') then 0 else 1 end group by 1)
    select c.citation_id, coalesce(donors, 0) as donors, coalesce(agreeing, 0) as agreeing, coalesce(agreeing, 0) > 0 as holds from citations c left join m using (citation_id) where c.count_method = 'title'""")
def projection_check(spark: SparkSession, d: str) -> DataFrame:
    """Counts reported as taken over by title, derived again: measured donors in reach, and those with the count."""
    cites = table(spark, d, "citations").select("citation_id", "doi", F.col("cited_by_count").alias("n"), "count_method", "measured")
    works = table(spark, d, "corpus").where("doi is not null").select(ids.norm_doi(F.col("doi")).alias("doi"), text.norm_title(F.col("title")).alias("title_key"), F.get("authors", F.lit(0))["name"].alias("author_key"), codes.norm_type(F.col("type")).alias("type"), "year").distinct()
    return gates.projection_check(cites.where("count_method = 'title'"), cites.where("count_method = 'cluster' and measured"), works)


@query(f"""with o as (select record_id, {S.norm_doi('doi')} as doi, abstract from corpus where length(trim(coalesce(abstract, ''))) > 60), w as (select {S.norm_doi('doi')} as doi, record_id from corpus where doi is not null and length(trim(coalesce(abstract, ''))) <= 60 or abstract is null)
    select w.record_id, min(o.record_id) as donor, count(*) as donors, count(distinct o.abstract) > 1 as disputed from w join o on w.doi = o.doi group by 1""")
def abstract_donors(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose abstract can only come from rows of the same DOI, with the donor and whether donors disagree."""
    c = table(spark, d, "corpus").select("record_id", ids.norm_doi(F.col("doi")).alias("doi"), "abstract")
    has = F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 60
    return joins.donors(c.where(~has).drop("abstract"), c.where(has), "doi", "record_id", "abstract")
