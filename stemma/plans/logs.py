"""The classification log: last write wins, history, resume, gaps, populations, validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes
from stemma.operators import gates, stats, tags
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


@query(f"select notice_id, tag_row_id, relevance, wave, round(confidence * 100) as confidence_pct from {S.LATEST}")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return tags.latest(table(spark, d, "tag_log")).select("notice_id", "tag_row_id", "relevance", "wave", F.round(F.col("confidence") * 100).alias("confidence_pct"))


@query(f"select tag_row_id, notice_id from tag_log where tag_row_id not in (select tag_row_id from {S.LATEST})")
def superseded_history(spark: SparkSession, d: str) -> DataFrame:
    return tags.superseded(table(spark, d, "tag_log")).select("tag_row_id", "notice_id")


@query(f"select l.notice_id, f.first_row, l.tag_row_id as winning_row, f.n - 1 as superseded from {S.LATEST} l join (select notice_id, min(tag_row_id) first_row, count(*) n from tag_log group by 1) f using (notice_id)")
def first_position(spark: SparkSession, d: str) -> DataFrame:
    return tags.first_position(table(spark, d, "tag_log"))


@query("select tag_row_id, notice_id, version from (select tag_row_id, notice_id, row_number() over (partition by notice_id order by tag_row_id) as version from tag_log)")
def tag_versions(spark: SparkSession, d: str) -> DataFrame:
    return tags.history_order(table(spark, d, "tag_log").select("tag_row_id", "notice_id"), "notice_id", "tag_row_id")


@query("""with done as (select distinct notice_id, input_digest from tag_log where wave = 'w1' and prompt_version = 'v2' and vocabulary_version = 'v2')
    select distinct t.notice_id, t.input_digest from tag_log t where not exists (select 1 from done where done.notice_id = t.notice_id and done.input_digest = t.input_digest)""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Notices (id and input) that the first wave under the second prompt has still to tag."""
    log = table(spark, d, "tag_log")
    return tags.to_tag(log.select("notice_id", "input_digest").distinct(), log, "input_digest", "w1", "v2", "v2").select("notice_id", "input_digest")


@query("""with k as (select notice_id, input_digest, wave = 'w1' as first from tag_log), a as (select notice_id, max(case when first then input_digest end) as old_digest, max(case when not first then input_digest end) as new_digest from k group by 1)
    select notice_id, old_digest, new_digest from a where old_digest is not null and new_digest is not null and old_digest <> new_digest""")
def stale_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Notices whose input has changed since the first wave."""
    k = table(spark, d, "tag_log").groupBy("notice_id").agg(F.max(F.when(F.col("wave") == "w1", F.col("input_digest"))).alias("old_digest"), F.max(F.when(F.col("wave") != "w1", F.col("input_digest"))).alias("new_digest"))
    return k.where("old_digest is not null and new_digest is not null and old_digest != new_digest")


@query(f"""with c as (select notice_id, title, {S.norm_doi('doi')} as doi from {S.CURRENT}), l as (select notice_id from {S.LATEST}),
    s as (select distinct c.doi from c join l using (notice_id) where c.doi is not null)
    select c.notice_id, case when s.doi is not null then 'tagged under another record' when c.title is null then 'no title' else 'never tagged' end as cause
    from c left join s on s.doi = c.doi where c.notice_id not in (select notice_id from l)""")
def gap_causes(spark: SparkSession, d: str) -> DataFrame:
    from stemma.functions.ids import norm_doi

    n = current(spark, d, "title", "doi").select("notice_id", "title", norm_doi(F.col("doi")).alias("doi"))
    return tags.gaps(n, table(spark, d, "tag_log")).select("notice_id", "cause")


@query(f"select notice_id, relevance from {S.LATEST} where notice_id not in (select notice_id from {S.NOTICES})")
def orphan_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.orphans(table(spark, d, "tag_log"), current(spark, d)).select("notice_id", "relevance")


@query(f"""select standing, count(*) as n from (select case when l.relevance in ('core', 'partial') then 'counted' when l.relevance = 'marginal' then 'mentioned' when l.relevance = 'none' then 'out' else 'aside' end as standing
    from {S.NOTICES} n left join {S.LATEST} l using (notice_id)) group by 1""")
def population_split(spark: SparkSession, d: str) -> DataFrame:
    return tags.population(current(spark, d), table(spark, d, "tag_log")).groupBy("standing").agg(F.count("*").alias("n"))


@query(f"""select n.notice_id, l.relevance from {S.CURRENT} n join {S.LATEST} l using (notice_id) where l.relevance in ('core', 'partial', 'marginal') and not coalesce(n.noise_guess and n.source not in ('theokat', 'bibindex'), false)""")
def perimeter(spark: SparkSession, d: str) -> DataFrame:
    """Closed by default: only tagged notices from marginal up; noise only from curated sources."""
    p = tags.population(current(spark, d, "noise_guess"), table(spark, d, "tag_log"))
    noise = F.coalesce(F.col("noise_guess") & ~F.col("source").isin("theokat", "bibindex"), F.lit(False))
    return p.where(F.coalesce(tags.relevance_at_least(F.col("relevance"), "marginal"), F.lit(False)) & ~noise).select("notice_id", "relevance")


@query(f"select wave, relevance, count(*) as n, cast(count(*) filter (where needs_review) as bigint) as in_review from {S.LATEST} group by 1, 2")
def classification_totals(spark: SparkSession, d: str) -> DataFrame:
    return tags.latest(table(spark, d, "tag_log")).groupBy("wave", "relevance").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("in_review"))


@query(f"""select theme, count(*) filter (where relevance in ('core', 'partial')) as counted, count(*) filter (where relevance = 'marginal') as mentioned
    from (select notice_id, relevance, unnest(list_distinct(themes)) as theme from {S.LATEST}) group by 1""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", "relevance", F.explode(F.array_distinct("themes")).alias("theme"))
    return stats.facet(t, "theme", F.col("relevance").isin("core", "partial"), F.col("relevance") == "marginal")


@query(f"""select work, count(*) as n from (select unnest(list_distinct(works)) as work from {S.LATEST} where relevance in ('core', 'partial')) group by 1""")
def work_counts(spark: SparkSession, d: str) -> DataFrame:
    return tags.latest(table(spark, d, "tag_log")).where(F.col("relevance").isin("core", "partial")).select(F.explode(F.array_distinct("works")).alias("work")).groupBy("work").agg(F.count("*").alias("n"))


@query(f"""with u as (select 'theme' as axis, unnest(themes) as term from {S.LATEST} union all select 'work', unnest(works) from {S.LATEST} union all select 'approach', unnest(approaches) from {S.LATEST}) select axis, term, count(*) as uses from u group by 1, 2""")
def vocabulary_usage(spark: SparkSession, d: str) -> DataFrame:
    t = tags.latest(table(spark, d, "tag_log"))
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("terms")) for a, c in (("theme", "themes"), ("work", "works"), ("approach", "approaches"))]))
    return t.select(axes.alias("x")).select("x.axis", F.explode("x.terms").alias("term")).groupBy("axis", "term").agg(F.count("*").alias("uses"))


@query(f"""select decade, lang, count(*) as n from (select {S.decade('c.year')} as decade, {S.norm_lang('c.language')} as lang from {S.CURRENT} c join {S.LATEST} l using (notice_id) where l.relevance in ('core', 'partial')) group by 1, 2""")
def decade_lang_crosstab(spark: SparkSession, d: str) -> DataFrame:
    p = tags.population(current(spark, d, "year", "language"), table(spark, d, "tag_log")).where("standing = 'counted'")
    return p.groupBy(codes.decade(F.col("year")).alias("decade"), codes.norm_lang(F.col("language")).alias("lang")).agg(F.count("*").alias("n"))


_ALLOWED = "select distinct unnest({c}) from (select {c} from tag_log)"


@query("""select tag_row_id, array_to_string(list_filter([
    case when not coalesce(regexp_matches(notice_id, '^[^:]+:.+$'), false) then 'notice_id' end,
    case when not coalesce(relevance in ('none', 'marginal', 'partial', 'core'), false) then 'relevance' end,
    case when not coalesce(relevance = 'none' or relevance_none_reason is null, false) then 'none_reason' end,
    case when not coalesce(len(works) <= 4, false) then 'works' end, case when not coalesce(len(themes) <= 5, false) then 'themes' end,
    case when not coalesce(len(approaches) between 0 and 2, false) then 'approaches' end, case when not coalesce(confidence between 0 and 1, false) then 'confidence' end,
    case when not coalesce(len(list_distinct(themes)) = len(themes), false) then 'distinct' end,
    case when not coalesce(regexp_matches(input_digest, '^[0-9a-f]{16}$'), false) then 'digest' end,
    case when not coalesce(regexp_matches(tagged_at, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$'), false) then 'tagged_at' end], lambda x: x is not null), ',') as errors from tag_log""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    v = gates.violations(table(spark, d, "tag_log"), gates.tag_rules(tags.RELEVANCE))
    return v.select("tag_row_id", F.array_join("errors", ",").alias("errors"))


@query("""with a as (select *, source in ('theokat', 'bibindex') as curated, relation = 'by' as by_subject from (select t.*, split_part(t.notice_id, ':', 1) as source, c.relation from tag_log t left join
      (select source || ':' || source_id as nid, max_by(relation, record_id) filter (where relation is not null) as relation from corpus group by 1) c on c.nid = t.notice_id)),
    b as (select *, case when relevance <> 'none' then 'not-applicable' else coalesce(nullif(trim(relevance_none_reason), ''), 'not-applicable') end as reason from a),
    f as (select *, coalesce(curated and relevance = 'none' and reason not in ('homonym', 'text-by-subject'), false) as floor_applied from b),
    g as (select *, case when floor_applied then 'marginal' else relevance end as lifted from f),
    h as (select *, coalesce(by_subject, false) and lifted in ('core', 'partial') as ceiling_applied from g)
    select tag_row_id, case when ceiling_applied then 'marginal' else lifted end as relevance, floor_applied, ceiling_applied from h
    where reason in ('not-applicable', 'homonym', 'text-by-subject', 'false-positive', 'off-topic', 'no-information') and len(list_distinct(approaches)) > 0
      and (len(themes) > 0 or (case when ceiling_applied then 'marginal' else lifted end) in ('none', 'marginal'))""")
def tag_validation(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the log validated again: floor of curated sources, ceiling of texts by the subject, closed lists."""
    log = table(spark, d, "tag_log")
    rel = table(spark, d, "corpus").where("relation is not null").groupBy(F.concat("source", F.lit(":"), "source_id").alias("notice_id")).agg(F.max_by("relation", "record_id").alias("relation"))
    a = log.join(rel, "notice_id", "left").withColumn("source", F.substring_index("notice_id", ":", 1))
    a = a.withColumn("curated", F.col("source").isin("theokat", "bibindex")).withColumn("by_subject", F.coalesce(F.col("relation") == "by", F.lit(False)))
    lists = {c: sorted(r[0] for r in log.select(F.explode(c)).distinct().collect()) for c in ("works", "themes", "approaches")}  # closed vocabularies
    good, _ = tags.validate(a, lists["works"], lists["themes"], lists["approaches"])
    return good.select("tag_row_id", "relevance", "floor_applied", "ceiling_applied")


@query(f"select notice_id, tag_row_id, relevance from {S.LATEST}")
def stream_lww_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream, in micro-batches, into a latest-row table: equal to the batch result."""
    from stemma.session import shared_dir
    from stemma.streaming.tags import LatestTable, run_available

    root = f"{shared_dir(spark)}/lww-{uuid.uuid4().hex[:12]}"
    table(spark, d, "tag_log").repartition(4).write.parquet(f"{root}/log")
    t = LatestTable(f"{root}/table")
    run_available(spark, f"{root}/log", t, f"{root}/checkpoint")
    return t.read(spark).select("notice_id", "tag_row_id", "relevance")
