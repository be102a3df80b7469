"""Citation counts: ranks in cohorts, ladders, coverage, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, ids, text
from stemma.operators import joins, ranking, stats
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


def cited(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").select("citation_id", "work_id", "doi", "cited_by_count", "run_id", "measured", F.col("cohort.decade").alias("decade"), F.col("cohort.type").alias("type"), F.col("cohort.lang").alias("lang"))


_C = "(select citation_id, work_id, doi, cited_by_count, run_id, measured, cohort.decade as decade, cohort.type as type, cohort.lang as lang from citations)"


def _mid(keys: str) -> str:
    part = f"partition by {keys}" if keys else ""
    below = f"(2 * (rank() over ({part} order by cited_by_count) - 1) + count(*) over ({part + ',' if part else 'partition by '} cited_by_count))"
    return below, f"2 * count(*) over ({part})"


@query(f"select citation_id, {_mid('run_id, decade, type, lang')[0]} as rank_num, {_mid('run_id, decade, type, lang')[1]} as rank_den from {_C} where cited_by_count is not null")
def cohort_midrank(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.mid_rank(cited(spark, d).where("cited_by_count is not null"), ["run_id", "decade", "type", "lang"], "cited_by_count")
    return r.select("citation_id", "rank_num", "rank_den")


_LADDER = [("decade+type+lang", "run_id, decade, type, lang"), ("decade+type", "run_id, decade, type"), ("decade", "run_id, decade"), ("all", "run_id")]


def _ladder_sql(levels) -> str:
    cols = ", ".join(f"{_mid(k)[0]} as n{i}, {_mid(k)[1]} as d{i}" for i, (_, k) in enumerate(levels))
    pick = lambda what: "case " + " ".join(f"when d{i} >= 16 then {what(i)}" for i in range(len(levels) - 1)) + f" else {what(len(levels) - 1)} end"
    level = pick(lambda i: f"'{levels[i][0]}'")
    return f"""with m as (select citation_id, {cols} from {_C} where cited_by_count is not null), p as (select citation_id, {level} as cohort_level, {pick(lambda i: f'd{i} // 2')} as cohort_size, {pick(lambda i: f'n{i}')} as rank_num, {pick(lambda i: f'd{i}')} as rank_den from m)
    select c.citation_id, p.cohort_level, p.cohort_size, p.rank_num, p.rank_den from citations c left join p using (citation_id)"""


@query(_ladder_sql(_LADDER))
def cohort_fallback(spark: SparkSession, d: str) -> DataFrame:
    levels = [(n, k.split(", ")) for n, k in _LADDER]
    return ranking.cohort_ladder(cited(spark, d), levels, "cited_by_count").select("citation_id", "cohort_level", "cohort_size", "rank_num", "rank_den")


_WLADDER = [("decade+type+lang", "run_id, decade, type, lang"), ("decade+lang", "run_id, decade, lang"), ("decade", "run_id, decade"), ("all", "run_id")]


@query(_ladder_sql(_WLADDER))
def weight_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The other ladder of cohorts, which keeps the language before the type."""
    levels = [(n, k.split(", ")) for n, k in _WLADDER]
    return ranking.cohort_ladder(cited(spark, d), levels, "cited_by_count").select("citation_id", "cohort_level", "cohort_size", "rank_num", "rank_den")


@query(f"""select citation_id, case when n < 2 then 1 else rk - 1 end as pct_num, case when n < 2 then 2 else n - 1 end as pct_den from
    (select citation_id, rank() over (partition by run_id, decade, type, lang order by cited_by_count) as rk, count(*) over (partition by run_id, decade, type, lang) as n from {_C} where cited_by_count is not null)""")
def percentile_min_rank(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.min_rank_percentile(cited(spark, d).where("cited_by_count is not null"), ["run_id", "decade", "type", "lang"], "cited_by_count")
    return r.select("citation_id", "pct_num", "pct_den")


@query("select work_id, min(cited_by_count) as cited_by_count from citations where run_id = (select max(run_id) from citations) and cited_by_count is not null group by 1 having count(distinct cited_by_count) = 1")
def citation_conflict_drop(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last run; works with two different counts in it are dropped, not resolved."""
    c = table(spark, d, "citations").select("work_id", "cited_by_count", "run_id")
    last = c.agg(F.max("run_id")).first()[0]
    return joins.agreed(c.where(F.col("run_id") == F.lit(last)), "work_id", "cited_by_count")


@query(f"""with x as (select decade, type, lang, cited_by_count is not null as has from {_C})
    select 'decade' as dim, coalesce(decade, '?') as value, count(*) as n, count(*) filter (where has) as covered from x group by 2
    union all select 'type', coalesce(type, '?'), count(*), count(*) filter (where has) from x group by 2
    union all select 'lang', coalesce(lang, '?'), count(*), count(*) filter (where has) from x group by 2
    union all select 'all', 'all', count(*), count(*) filter (where has) from x""")
def coverage_by_dim(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(cited(spark, d), ["decade", "type", "lang"], F.col("cited_by_count").isNotNull())


_WORKS = f"""(select c.record_id, {S.norm_title('c.title')} as title_key, c.authors[1].name as author_key, {S.norm_type('c.type')} as type, c.year, {S.norm_doi('c.doi')} as doi from corpus c)"""
_COUNTS = "(select doi, min(cited_by_count) as n from citations where doi is not null and cited_by_count is not null group by 1 having count(distinct cited_by_count) = 1)"


def _works(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus")
    return c.select("record_id", text.norm_title(F.col("title")).alias("title_key"), F.get("authors", F.lit(0))["name"].alias("author_key"), codes.norm_type(F.col("type")).alias("type"), "year", ids.norm_doi(F.col("doi")).alias("doi"))


@query(f"""with w as (select w.*, k.n from {_WORKS} w left join {_COUNTS} k using (doi)), u as (select * from w where title_key <> '' and author_key is not null and year is not null and type not in ('?', 'other'))
    select t.record_id, min(g.n) as cited_by_count from u t join u g on t.title_key = g.title_key and t.author_key = g.author_key and t.type = g.type and g.n is not null and t.n is null
      and abs(t.year - g.year) <= case when t.type in ('article', 'review') then 0 else 1 end group by 1 having count(distinct g.n) = 1""")
def title_projection(spark: SparkSession, d: str) -> DataFrame:
    """Counts that rows without one take over from rows of the same title, author and type."""
    counts = joins.agreed(table(spark, d, "citations").where("doi is not null"), "doi", "cited_by_count")
    w = _works(spark, d).join(counts, "doi", "left")
    return joins.project_by_title(w.where("cited_by_count is null").drop("cited_by_count"), w, "cited_by_count").select("record_id", "cited_by_count")


_ABS = "(select record_id, source || ':' || source_id as nid, {0} as doi, {1} as tkey, year, abstract from corpus)".format(S.norm_doi("doi"), S.norm_title("title"))
_OK = "abstract is not null and length(trim(abstract)) > 60"


@query(f"""with x as materialized (select * from {_ABS}), lost as (select record_id, nid, doi, case when length(tkey) >= 25 then tkey end as tkey from x where not coalesce({_OK}, false)),
    a as (select nid, min(abstract) v from x where {_OK} group by 1 having count(distinct abstract) = 1), b as (select doi, min(abstract) v from x where {_OK} and doi is not null group by 1 having count(distinct abstract) = 1),
    c as (select tkey, min(abstract) v from x where {_OK} and length(tkey) >= 25 group by 1 having count(distinct abstract) = 1)
    select record_id, coalesce(a.v, b.v, c.v) as abstract, case when a.v is not null then 'id' when b.v is not null then 'doi' when c.v is not null then 'title' end as method
    from lost left join a using (nid) left join b on b.doi = lost.doi left join c on c.tkey = lost.tkey where coalesce(a.v, b.v, c.v) is not null""")
def join_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts for rows without one: by id, else DOI, else a long title; keys whose donors disagree give none."""
    c = table(spark, d, "corpus")
    t = text.norm_title(F.col("title"))
    x = c.select("record_id", F.concat("source", F.lit(":"), "source_id").alias("nid"), ids.norm_doi(F.col("doi")).alias("doi"), F.when(F.length(t) >= 25, t).alias("tkey"), "abstract")
    ok = F.coalesce(F.length(F.trim("abstract")) > 60, F.lit(False))
    donors = x.where(ok)
    steps = [("id", donors.select("nid", "abstract"), None), ("doi", donors.select("doi", "abstract"), None), ("title", donors.select("tkey", "abstract"), None)]
    return joins.cascade(x.where(~ok).drop("abstract"), "record_id", steps, "abstract").where("method is not null").select("record_id", "abstract", "method")


@query(f"""select citation_id, case when cited_by_count is null then null when pct < 0.2 then 1 when pct < 0.4 then 2 when pct < 0.6 then 3 when pct < 0.8 then 4 else 5 end as tier from
    (select citation_id, cited_by_count, case when count(*) over (partition by run_id) < 2 then 0.5 else (rank() over (partition by run_id order by cited_by_count) - 1) / (count(*) over (partition by run_id) - 1) end as pct from {_C} where cited_by_count is not null)""")
def weight_tiers(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.min_rank_percentile(cited(spark, d).where("cited_by_count is not null"), ["run_id"], "cited_by_count")
    return r.select("citation_id", ranking.weight_tier(F.col("pct_num") / F.col("pct_den")).alias("tier"))


@query("select source, cast(count(*) as bigint) as n, cast(count(*) filter (where measured) as bigint) as measured, cast(sum(cited_by_count) as bigint) as citations, max(cited_by_count) as top from citations group by 1")
def citation_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").groupBy("source").agg(F.count("*").alias("n"), F.count_if("measured").alias("measured"), F.sum("cited_by_count").cast("bigint").alias("citations"), F.max("cited_by_count").alias("top"))


_ = current
