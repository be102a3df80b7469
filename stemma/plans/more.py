"""Joins of sources to tags, series by language, reports, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, headings, ids, text
from stemma.operators import golden, tags
from stemma.plans import linked
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


@query(f"""with s as (select record_id, unnest(sources) as s, unnest(range(len(sources))) as pos from corpus), t as (select record_id, pos, s.source || ':' || s.source_id as nid from s),
    j as (select t.record_id, t.pos, l.notice_id, l.relevance from t join {S.LATEST} l on l.notice_id = t.nid), r as (select *, row_number() over (partition by record_id order by pos) as k from j)
    select record_id, notice_id, relevance from r where k = 1""")
def source_pair_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tag of the first of a row's source pairs that has one."""
    pairs = table(spark, d, "corpus").select("record_id", F.posexplode("sources").alias("pos", "s")).select("record_id", "pos", F.concat("s.source", F.lit(":"), "s.source_id").alias("notice_id"))
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", "relevance")
    return pairs.join(t, "notice_id").groupBy("record_id").agg(F.min_by(F.struct("notice_id", "relevance"), "pos").alias("m")).select("record_id", "m.*")


_OWN = "abstract is not null and length(trim(abstract)) > 60"


@query(f"""with c as (select record_id, {S.norm_doi('doi')} as doi, case when {_OWN} then abstract end as own from corpus), d as (select doi, min(own) as joined from c where doi is not null and own is not null group by 1)
    select c.record_id, coalesce(c.own, d.joined) as abstract, case when c.own is not null then 'own' when d.joined is not null then 'joined' end as origin from c left join d using (doi) where coalesce(c.own, d.joined) is not null""")
def own_or_joined_abstract(spark: SparkSession, d: str) -> DataFrame:
    """The own abstract first; one joined by DOI only fills."""
    own = F.when(F.coalesce(F.length(F.trim("abstract")) > 60, F.lit(False)), F.col("abstract"))
    c = table(spark, d, "corpus").select("record_id", ids.norm_doi(F.col("doi")).alias("doi"), own.alias("own"))
    donors = c.where("doi is not null and own is not null").groupBy("doi").agg(F.min("own").alias("joined"))
    j = c.join(donors, "doi", "left").where("own is not null or joined is not null")
    return j.select("record_id", F.coalesce("own", "joined").alias("abstract"), F.when(F.col("own").isNotNull(), "own").otherwise("joined").alias("origin"))


@query(f"""with c as (select year, {S.norm_lang('language')} as lang from corpus where year is not null), top as (select lang from c group by 1 order by count(*) desc, lang limit 6)
    select year, case when lang in (select lang from top) then lang else 'oth' end as lang, count(*) as n from c group by 1, 2""")
def year_language_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rows per year for the six most frequent languages and the rest."""
    c = table(spark, d, "corpus").where("year is not null").select("year", codes.norm_lang(F.col("language")).alias("lang"))
    top = [r["lang"] for r in c.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(6).collect()]  # six names
    return c.groupBy("year", F.when(F.col("lang").isin(top), F.col("lang")).otherwise("oth").alias("lang")).agg(F.count("*").alias("n"))


@query(f"""with k as (select *, {S.norm_doi('doi')} as cluster from corpus), g as (select cluster, count(*) as n_rows, count(*) filter (where trim(coalesce(abstract, '')) <> '') as a from k where cluster is not null group by 1)
    select cast(sum(n_rows) as bigint) as rows_in, count(*) as clusters_out, count(*) filter (where n_rows > 1) as clusters_merged, count(*) filter (where a > 0) as with_abstract, cast(sum(n_rows) as bigint) - count(*) as collapsed from g""")
def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """One row of figures on the merge by DOI."""
    rows = linked._ranked(spark, d)
    m = golden.merge(rows, "cluster", "priority", ["record_id"], ("title",))
    r = golden.merge_report(rows, m, golden.conflicts(rows, m, "cluster", ("title",)))
    return r.select("rows_in", "clusters_out", "clusters_merged", "with_abstract", "collapsed")


@query(f"""with h as (select doc_id, unnest(string_split(split_part(text, chr(10), 1), ':')) as x from documents), c as (select doc_id, {S.squeeze("translate(regexp_replace(regexp_replace(x, '\\s*--.*$', ''), '\\s+/\\s.*$', ''), '<>', '()')")} as h from h)
    select h as heading, count(distinct doc_id) as n from c where length(h) between 2 and 60 and not regexp_matches(h, '(?i)^(?:to|until|bis|jusqu).*\\d|^\\d{{1,4}}\\s*[-–]\\s*\\d{{0,4}}$|\\d(?:st|nd|rd|th) century|jahrhundert|siècle|geschichte \\d') group by 1 having count(distinct doc_id) >= 3""")
def heading_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned headings (here the parts of first lines) that three documents or more share."""
    first = F.substring_index("text", "\n", 1)
    h = table(spark, d, "documents").select("doc_id", first.alias("l"))
    h = h.select("doc_id", F.explode(headings.clean_headings(F.translate("l", ":;", ";\x1e"))).alias("heading")).withColumn("heading", F.translate("heading", "\x1e", ";"))
    return h.groupBy("heading").agg(F.count_distinct("doc_id").alias("n")).where("n >= 3")


@query(f"""with v as (select distinct unnest(works) as key from tag_log), a as (select key, {S.squeeze(S.fold('key'))} as alias from v) select alias, array_to_string(list_sort(list(key)), ';') as keys from a where length(alias) >= 4 group by 1""")
def alias_index(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "tag_log").select(F.explode("works").alias("key")).distinct().select("key", F.col("key").alias("label"), F.lit(None).cast("array<string>").alias("aliases"))
    return headings.alias_index(v).select("alias", F.array_join("keys", ";").alias("keys"))


@query(f"""select run_id, count(*) as tagged, count(distinct notice_id) as notices, cast(count(*) filter (where needs_review) as bigint) as in_review, cast(count(*) filter (where relevance = 'none') as bigint) as out, min(tagged_at) as first_at, max(tagged_at) as last_at from tag_log group by 1""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag_log").groupBy("run_id").agg(
        F.count("*").alias("tagged"), F.count_distinct("notice_id").alias("notices"), F.count_if("needs_review").alias("in_review"), F.count_if(F.col("relevance") == "none").alias("out"), F.min("tagged_at").alias("first_at"), F.max("tagged_at").alias("last_at")
    )


@query(f"""select notice_id, source, priority from (select source || ':' || source_id as notice_id, max(source) as source, min(coalesce(p.trust_rank, 99)) as priority from corpus left join source_policy p using (source) group by 1)
    where notice_id not in (select notice_id from {S.LATEST}) order by priority, notice_id limit 100""")
def tagging_queue(spark: SparkSession, d: str) -> DataFrame:
    """The next hundred notices to tag, by the order of their source."""
    p = table(spark, d, "source_policy").select("source", "trust_rank")
    n = current(spark, d).join(F.broadcast(p), "source", "left").select("notice_id", "source", F.coalesce("trust_rank", F.lit(99)).alias("priority"))  # the policy is a fixed table
    return n.join(tags.latest(table(spark, d, "tag_log")).select("notice_id"), "notice_id", "left_anti").orderBy("priority", "notice_id").limit(100)


@query(f"""select c.notice_id, case when l.relevance in ('core', 'partial') then true else false end as counted, c.title from {S.CURRENT} c join {S.LATEST} l using (notice_id) where l.relevance in ('core', 'partial', 'marginal') and c.relation = 'by'""")
def primary_layer(spark: SparkSession, d: str) -> DataFrame:
    """Texts by the subject among the published notices."""
    p = tags.population(current(spark, d, "title", "relation"), table(spark, d, "tag_log")).where("relation = 'by' and standing in ('counted', 'mentioned')")
    return p.select("notice_id", (F.col("standing") == "counted").alias("counted"), "title")



