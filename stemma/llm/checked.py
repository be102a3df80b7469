"""Queries on what the operators promise, each with SQL that states the promise from the input alone.

The operators themselves rest on searches and trained machines that SQL cannot express;
these queries run them over the whole tables and reduce their results to what must hold
exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import p1_neardup, p2_visual, p3_names, p4_digest, p4_queries, p7_packing, p8_mixing, p9_toxicity
from stemma.plans.base import register
from stemma.session import materialize, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: rank errors that percentiles may have
RANK_ERROR = 0.02


@query("""select a.record_id as record_id_a, b.record_id as record_id_b, true as together from corpus a join corpus b on a.source = b.source and a.source_id = b.source_id and a.record_id < b.record_id""")
def p1_redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of deliveries of one notice, and whether the groups hold it together."""
    c = table(spark, d, "corpus")
    g = p1_neardup.groups(c)
    rows = c.select("record_id", "source", "source_id").join(g, "record_id", "left")
    side = lambda s: rows.select("source", "source_id", F.col("record_id").alias(f"record_id_{s}"), F.col("group_id").alias(f"g_{s}"))
    return side("a").join(side("b"), ["source", "source_id"]).where("record_id_a < record_id_b").select("record_id_a", "record_id_b", F.coalesce(F.col("g_a") == F.col("g_b"), F.lit(False)).alias("together"))


@query("""with v as (select record_id, 'title' as field, 0 as pos, title as form from corpus union all
      select record_id, 'authors', pos - 1, authors[pos].name from (select record_id, authors, unnest(range(1, len(authors) + 1)) as pos from corpus where authors is not null))
    select record_id, field, cast(pos as int) as pos, form, form is not null and form <> nfc_normalize(form) as apart from v where form is null or regexp_full_match(form, '[\\x00-\\x7F]*')""")
def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    """Values of plain characters keep their place and form; ``apart`` tells that a form is not composed."""
    c = table(spark, d, "corpus")
    base = c.select("record_id", F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value")).unionByName(c.select("record_id", F.lit("authors").alias("field"), F.posexplode("authors.name").alias("pos", "value")))
    plain = base.where("value is null or not value rlike '[^\\\\x00-\\\\x7F]'").select("record_id", "field", "pos")
    return p2_visual.canonical_forms(c).join(plain, ["record_id", "field", "pos"]).select("record_id", "field", "pos", "form", F.col("changed").alias("apart"))


@query("""with g as (select gnd, min(entity_id) as entity_id from authority where gnd is not null group by 1 having count(*) = 1),
    m as (select record_id, pos, authors[pos].gnd as gnd, authors[pos].name as name from (select record_id, authors, unnest(range(1, len(authors) + 1)) as pos from corpus where authors is not null))
    select record_id, cast(pos - 1 as int) as author_pos, entity_id from m join g using (gnd) where regexp_matches(name, '\\p{L}')""")
def p3_by_number(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every mention that carries an authority number."""
    c, authority = table(spark, d, "corpus"), table(spark, d, "authority")
    known = authority.where("gnd is not null").select("gnd").distinct()
    numbered = c.select("record_id", F.posexplode("authors").alias("author_pos", "a")).select("record_id", "author_pos", F.col("a.gnd").alias("gnd")).join(known, "gnd", "left_semi")
    return p3_names.resolve(c, authority).join(numbered.select("record_id", "author_pos"), ["record_id", "author_pos"], "left_semi").select("record_id", "author_pos", "entity_id")


_MEASURED = "(select distinct work_id, run_id, cohort.decade as decade, cohort.type as type, cohort.lang as lang from citations where measured and cited_by_count is not null)"


@query(f"""select decade, type, lang, run_id, q, count(*) as n, true as within from {_MEASURED}, (select unnest([{', '.join(f'cast({q} as double)' for q in p4_digest.PERCENTILES)}]) as q) group by 1, 2, 3, 4, 5""")
def p4_certified(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort, run and percentile: how many values, and whether the counted rank error stays within ``RANK_ERROR``."""
    return p4_queries.p4_percentiles(spark, d).select("decade", "type", "lang", "run_id", "q", "n", (F.col("rank_error") <= RANK_ERROR).alias("within"))


@query(f"""select decade, type, lang, q, count(*) as n, true as within from {_MEASURED}, (select unnest([{', '.join(f'cast({q} as double)' for q in p4_digest.PERCENTILES)}]) as q) group by 1, 2, 3, 4""")
def p4_combined_certified(spark: SparkSession, d: str) -> DataFrame:
    """The same of the digests of all runs, combined."""
    return p4_queries.p4_combined(spark, d).select("decade", "type", "lang", "q", "n", (F.col("rank_error") <= RANK_ERROR).alias("within"))


@query("select doc_id, true as whole from documents where text <> ''")
def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every document that has a text is packed, and its pieces are the whole of it: one piece, or full ones and a rest."""
    sizes = materialize(p7_packing.document_sizes(table(spark, d, "documents")), "sizes")
    top = max(p7_packing.TIERS)
    p = p7_packing.pack(sizes).groupBy("doc_id").agg(F.sum("length").alias("packed"), F.count("*").alias("pieces"), F.min("start").alias("first"))
    return p.join(sizes, "doc_id").select("doc_id", ((F.col("packed") == F.col("tokens")) & (F.col("pieces") == F.ceil(F.col("tokens") / top)) & (F.col("first") == 0)).alias("whole"))


@query("""with t as (select source, sum(target_share) as target_share, min(max_repeats) as max_repeats from mix_targets group by 1), h as (select source, count(*) as docs, count(*) filter (where text <> '') as told from documents group by 1),
    j as (select t.*, coalesce(docs, 0) as docs, coalesce(told, 0) as told from t left join h using (source))
    select source, docs, cast(round(1e6 * case when told > 0 then target_share / (select sum(target_share) from j where told > 0) else 0 end) as bigint) as wanted_millionths, true as capped from j""")
def p8_wanted(spark: SparkSession, d: str) -> DataFrame:
    """What each listed source is to contribute, and that no document is given out more often than its source allows."""
    s = p8_mixing.shares(p8_mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return s.select("source", "docs", F.round(F.col("wanted_share") * 1e6).cast("bigint").alias("wanted_millionths"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


@query("select source, count(*) as documents from documents group by 1")
def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document of every source is scored."""
    return p9_toxicity.rates(table(spark, d, "documents"), table(spark, d, "review_labels")).select("source", "documents")
