"""Counts, series, crosstabs, top lists and reports over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, text
from stemma.operators import gates, stats
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


@query("select source, count(*) filter (where noise_guess) as noise, count(*) filter (where not noise_guess) as kept, count(*) filter (where noise_guess is null) as undecided, count(*) as total from corpus group by 1")
def noise_by_source(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").select("source", codes.noise_bucket(F.col("noise_guess")).alias("bucket"))
    return stats.pivot_counts(c, "source", "bucket", ["noise", "kept", "undecided"])


@query("""with s as (select unnest(range(1900, 2027)) as year), c as (select year, count(*) as n, count(abstract) as with_abstract from corpus where year is not null group by 1)
    select cast(s.year as int) as year, coalesce(n, 0) as n, coalesce(with_abstract, 0) as with_abstract from s left join c on c.year = s.year""")
def year_series_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").where("year is not null").groupBy("year").agg(F.count("*").alias("n"), F.count("abstract").alias("with_abstract"))
    return stats.zero_filled(c, "year", 1900, 2026)


@query("select (year // 10) * 10 as decade, count(*) as n from corpus where year between 1900 and 2026 group by 1")
def decades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").where("year between 1900 and 2026").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query("select count(*) as records, count(distinct container) as containers, count(distinct source || ':' || source_id) as notices, min(year) as min_year, max(year) as max_year, count(*) - count(year) as undated, count(*) - count(title) as untitled from corpus")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").agg(
        F.count("*").alias("records"), F.count_distinct("container").alias("containers"), F.count_distinct(F.concat("source", F.lit(":"), "source_id")).alias("notices"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("title").isNull()).alias("untitled"),
    )


@query(f"""with k as (select {S.norm_title('container')} as key, container as label, count(*) as n from corpus where container is not null group by 1, 2),
    r as (select key, label, sum(n) over (partition by key) as total, row_number() over (partition by key order by n desc, length(label) desc, label) as rn from k)
    select key, label, cast(total as bigint) as count from r where rn = 1 order by total desc, key limit 30""")
def topk_preferred_label(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").where("container is not null").select(text.norm_title(F.col("container")).alias("key"), F.col("container").alias("label"))
    return stats.top_labels(c, "key", "label", 30)


@query("""with c as (select container, coalesce(type, '?') as type, count(*) as n from corpus where container is not null group by 1, 2), r as (select *, row_number() over (partition by container order by n desc, type) as rn, sum(n) over (partition by container) as total from c)
    select container, type, n, cast(total as bigint) as total from r where rn = 1""")
def container_mode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").select("container", F.coalesce("type", F.lit("?")).alias("type"))
    return stats.mode_label(c, "container", "type")


@query("select source, count(*) as n, count(distinct source_id) as notices, count(doi) as with_doi, count(abstract) as with_abstract, count(year) as dated, min(year) as min_year, max(year) as max_year from corpus group by 1")
def overview_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("notices"), F.count("doi").alias("with_doi"), F.count("abstract").alias("with_abstract"), F.count("year").alias("dated"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


@query("select q as query, source, count(*) as n, count(distinct source_id) as notices from (select source, source_id, unnest(query_matched) as q from corpus) group by 1, 2")
def per_query_yield(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "corpus").select("source", "source_id", F.explode("query_matched").alias("query"))
    return q.groupBy("query", "source").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("notices"))


@query(f"""select {S.norm_type('type')} as type_norm, {S.norm_lang('language')} as lang, count(*) as n from corpus group by cube (1, 2)""".replace("group by cube (1, 2)", f"group by cube ({S.norm_type('type')}, {S.norm_lang('language')})"))
def type_lang_cube(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").select(codes.norm_type(F.col("type")).alias("type_norm"), codes.norm_lang(F.col("language")).alias("lang"))
    return c.cube("type_norm", "lang").agg(F.count("*").alias("n"))


@query("""select record_id, case when p.source is null then 'unknown_source' when c.url is null then 'no_url'
      when not coalesce(len(list_filter(p.hosts, lambda h: lower(regexp_extract(c.url, '^https?://([^/:?#]+)', 1)) = h or ends_with(lower(regexp_extract(c.url, '^https?://([^/:?#]+)', 1)), '.' || h))) > 0, false) then 'bad_host' else 'attributed' end as status
    from corpus c left join source_policy p using (source)""")
def attribution_status(spark: SparkSession, d: str) -> DataFrame:
    return gates.attribution(table(spark, d, "corpus").select("record_id", "source", "url"), table(spark, d, "source_policy")).select("record_id", "status")


@query()
def url_resolvable(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that may be published; checked by unit tests."""
    return table(spark, d, "corpus").where("url is not null").select("record_id", gates.url_resolvable("url").alias("ok"))


@query("select record_id, coalesce(regexp_matches(source_id, '^[A-Za-z0-9][A-Za-z0-9._:/-]{0,120}$'), false) and not coalesce(contains(source_id, '..'), false) as safe from corpus")
def safe_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("record_id", gates.safe_identifier(F.col("source_id")).alias("safe"))


@query("select source, source_id, count(*) as deliveries, min(record_id) as first_record, max(record_id) as last_record from corpus group by 1, 2 having count(*) > 1")
def redelivered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").groupBy("source", "source_id").agg(F.count("*").alias("deliveries"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record")).where("deliveries > 1")


@query("""with o as (select source, source_id, record_id, unnest(coalesce(query_matched, [])) as q from corpus), f as (select source, source_id, min(record_id) as first_record,
      arg_min(title, record_id) filter (where trim(coalesce(title, '')) <> '') as title, arg_min(doi, record_id) filter (where trim(coalesce(doi, '')) <> '') as doi from corpus group by 1, 2)
    select f.source, f.source_id, f.first_record, f.title, f.doi, coalesce(string_agg(distinct o.q, ';' order by o.q), '') as queries from f left join o on o.source = f.source and o.source_id = f.source_id group by 1, 2, 3, 4, 5""")
def upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Per natural key: first delivery wins, empty fields filled from later ones, matched queries united."""
    from stemma.operators.joins import first_non_empty

    c = table(spark, d, "corpus").select(F.concat_ws("\x1f", "source", "source_id").alias("k"), "source", "source_id", "record_id", "title", "doi", "query_matched").withColumn("first_record", F.col("record_id"))
    c = c.withColumn("title", F.when(F.trim("title") != "", F.col("title"))).withColumn("doi", F.when(F.trim("doi") != "", F.col("doi")))
    m = first_non_empty(c, "k", ["record_id"], ["source", "source_id", "first_record", "title", "doi"], ["query_matched"])
    return m.select("source", "source_id", "first_record", "title", "doi", F.array_join("query_matched", ";").alias("queries"))


@query("select section, cast(n as bigint) as n, y2020, y2010, older from (select container as section, count(*) n, count(*) filter (where pub_year >= 2020) y2020, count(*) filter (where pub_year between 2010 and 2019) y2010, count(*) filter (where pub_year < 2010) older from documents where container is not null group by 1)")
def section_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("container is not null")
    return c.groupBy(F.col("container").alias("section")).agg(F.count("*").alias("n"), F.count_if(F.col("pub_year") >= 2020).alias("y2020"), F.count_if(F.col("pub_year").between(2010, 2019)).alias("y2010"), F.count_if(F.col("pub_year") < 2010).alias("older"))


@query("select distinct container from documents where container is not null and container not in (select container from corpus where container is not null)")
def containers_not_in_corpus(spark: SparkSession, d: str) -> DataFrame:
    from stemma.operators.joins import set_difference

    return set_difference(table(spark, d, "documents").where("container is not null").select("container").distinct(), table(spark, d, "corpus").where("container is not null"), ["container"])


@query("select record_id, abstract is not null and coalesce(abstract_rights in ('publisher', 'provider terms'), false) as abstract_withheld, case when not coalesce(abstract_rights in ('publisher', 'provider terms'), false) then abstract end as abstract from corpus")
def release_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    from stemma.sources.writers import release

    return release(table(spark, d, "corpus").select("record_id", "abstract", "abstract_rights"), strip=False, withdraw="^(publisher|provider terms)$").select("record_id", "abstract_withheld", "abstract")


_ = current
