"""Normalisers, identifiers and codes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, ids, text
from stemma.plans import sqltext as S
from stemma.plans.base import register
from stemma.session import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


@query(f"select record_id, {S.norm_title('title')} as title_norm from corpus")
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("record_id", text.norm_title(F.col("title")).alias("title_norm"))


@query(f"""select record_id, trim(regexp_replace({S.fold('title')}, '[^a-z0-9]+', ' ', 'g')) as latin,
    regexp_replace({S.squeeze(S.fold('title'))}, '^[.,;: ]+|[.,;: ]+$', '', 'g') as key,
    case when length(title) <= 40 then title else regexp_replace(substring(title, 1, 40), '[\\s.,;:]+$', '') || '…' end as short from corpus""")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "corpus").select("record_id", text.fold_title(t).alias("latin"), text.norm_key(t).alias("key"), text.truncate(t, 40).alias("short"))


@query(f"select doc_id, regexp_replace(regexp_replace({S.fold('container')}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def container_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("container")).alias("slug"))


@query(f"select record_id, doi_norm, split_part(doi_norm, '/', 1) as registrant from (select record_id, {S.norm_doi('doi')} as doi_norm from corpus)")
def norm_doi(spark: SparkSession, d: str) -> DataFrame:
    n = ids.norm_doi(F.col("doi"))
    return table(spark, d, "corpus").select("record_id", n.alias("doi_norm")).withColumn("registrant", ids.doi_prefix(F.col("doi_norm")))


_D = "regexp_replace(x, '[^0-9]', '', 'g')"
_SUM13 = "(list_sum(list_transform(range(1, 14), lambda i: cast(d[i:i] as int) * case when i % 2 = 1 then 1 else 3 end)))"


@query(f"""with e as (select record_id, unnest(list_concat(coalesce(isbn, []), [isbn_issn])) as x from corpus),
    n as (select distinct record_id, d from (select record_id, {_D} as d from e where x is not null) where length(d) = 13 and {_SUM13} % 10 = 0)
    select c.record_id, coalesce(string_agg(d, ';' order by d), '') as isbns from corpus c left join n on n.record_id = c.record_id group by 1""")
def isbn13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("record_id", F.array_join(ids.record_isbns(F.col("isbn"), F.col("isbn_issn")), ";").alias("isbns"))


_VOL = "vol|band|tome|tomo|tom|том|τομοσ"


@query(f"""select record_id, volume from (select record_id, regexp_extract({S.norm_title('title')}, '(?:^| )(?:{_VOL}) ([ivxlc]+|[0-9]{{1,3}})(?: |$)', 1) as volume from corpus) where volume <> ''""")
def volume_marks(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_extract(text.norm_title(F.col("title")), f"(?:^| )(?:{_VOL}) ([ivxlc]+|[0-9]{{1,3}})(?: |$)", 1)
    return table(spark, d, "corpus").select("record_id", v.alias("volume")).where("volume != ''")


@query(f"""with n as (select record_id, list_filter(regexp_extract_all({S.norm_title('title')}, '\\b(?:{ids.VOLUME_WORDS})\\s+([0-9]{{1,3}}|{ids.ROMAN_PATTERN})\\b', 1), lambda x: x <> '') as n from corpus),
    v as (select record_id, list_sort(list_distinct(list_transform(n, lambda x: {S.roman('x')}))) as v from n)
    select record_id, array_to_string(v, ',') as volume from v where len(v) > 0""")
def volume_signature(spark: SparkSession, d: str) -> DataFrame:
    """Sorted volume numbers, roman ones read."""
    v = ids.volume_signature(F.col("title"))
    return table(spark, d, "corpus").select("record_id", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("volume")).where("volume != ''")


@query()
def first_author_key(spark: SparkSession, d: str) -> DataFrame:
    """Surname key of the first author; checked by unit tests."""
    return table(spark, d, "corpus").select("record_id", ids.first_author_key(F.col("authors")).alias("author_key"))


@query(f"""select record_id, {S.norm_lang('language')} as lang, {S.norm_type('type')} as type_norm, {S.decade('year')} as decade,
    case when {S.norm_lang('language')} in ('en', 'de', 'fr', 'it', 'es') then {S.norm_lang('language')} else 'oth' end as lang_bucket from corpus""")
def codes_norm(spark: SparkSession, d: str) -> DataFrame:
    lang = codes.norm_lang(F.col("language"))
    return table(spark, d, "corpus").select("record_id", lang.alias("lang"), codes.norm_type(F.col("type")).alias("type_norm"), codes.decade(codes.norm_year(F.col("year"))).alias("decade"), codes.bucket_language(lang).alias("lang_bucket"))


@query(f"""with t as (select doc_id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') as t from documents),
    w as (select doc_id, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') as w, replace(t, ' ', '  ') as wide from t),
    s as (select doc_id, t, unnest([{', '.join(S.marker_score(k) for k in text.LANGUAGES)}]) as x from w),
    r as (select doc_id, t, x.score as score, x.lang as lang, row_number() over (partition by doc_id order by x.score desc) as k from s),
    b as (select doc_id, max(t) as t, max(case when k = 1 then lang end) as lang, max(case when k = 1 then score end) as best, max(case when k = 2 then score end) as second from r group by 1)
    select doc_id, case when length(t) >= 12 and len(regexp_extract_all(t, '\\S+')) >= 3 and best >= 3 and best - second >= 2 then lang end as guessed from b
    union all select doc_id, null from documents where text is null""")
def guess_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.guess_language(F.col("text")).alias("guessed"))


@query(f"select doc_id, cast(len({S.tokens('text')}) as bigint) as n_tokens, cast(len(list_distinct({S.tokens('text')})) as bigint) as n_distinct from documents")
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query(f"""select record_id, {S.squeeze("replace(regexp_replace(abstract, '<[^>]*>', ' ', 'g'), '&amp;', '&')")} as abstract_clean from corpus where trim(coalesce(abstract, '')) <> ''""")
def clean_abstract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").where("trim(coalesce(abstract, '')) <> ''").select("record_id", text.strip_tags(F.col("abstract")).alias("abstract_clean"))


@query("select doc_id, regexp_replace(text, '\\s+', ' ', 'g') as plain from documents")
def inverted_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Word -> positions and back: the text with its white space squeezed."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("p", "w"))
    inv = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return inv.select("doc_id", text.inverted_to_text(F.col("m")).alias("plain"))


_NOISE = (
    ("no title", "title is null or trim(title) = ''"),
    ("service title", "regexp_matches({f}, '^(preface|index|editorial|introduction|bibliography|abbreviations|front matter|book reviews|vorwort|einleitung|nachwort|avant-propos|introduzione|presentacion)[^a-z]*$')"),
    ("declared noise", "noise_guess"),
    ("declared kept", "not noise_guess"),
)


def _noise(f: str) -> str:
    return "case " + " ".join(f"when {c.format(f=f)} then '{n}'" for n, c in _NOISE) + " else 'undecided' end"


@query(f"select record_id, {_noise(S.fold('title'))} as rule from corpus")
def noise_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules, the first that fits."""
    f = text.fold(F.col("title"))
    service = "^(preface|index|editorial|introduction|bibliography|abbreviations|front matter|book reviews|vorwort|einleitung|nachwort|avant-propos|introduzione|presentacion)[^a-z]*$"
    rule = F.when(F.col("title").isNull() | (F.trim("title") == ""), "no title").when(f.rlike(service), "service title").when(F.col("noise_guess"), "declared noise").when(~F.col("noise_guess"), "declared kept").otherwise("undecided")
    return table(spark, d, "corpus").select("record_id", rule.alias("rule"))


@query("""select record_id, coalesce(array_to_string(list_transform(list_filter(authors, lambda a: coalesce(a.type, '') <> 'corporate' and coalesce(a.role, 'aut') = 'aut' and trim(coalesce(a.name, '')) <> ''), lambda a: a.name), '; '), '') as persons,
    cast(coalesce(len(list_filter(authors, lambda a: a.type = 'corporate')), 0) as bigint) as corporate from corpus""")
def record_authors(spark: SparkSession, d: str) -> DataFrame:
    keep = F.filter("authors", lambda a: (F.coalesce(a["type"], F.lit("")) != "corporate") & (F.coalesce(a["role"], F.lit("aut")) == "aut") & (F.trim(F.coalesce(a["name"], F.lit(""))) != ""))
    n = F.size(F.filter("authors", lambda a: F.coalesce(a["type"] == "corporate", F.lit(False))))
    return table(spark, d, "corpus").select("record_id", F.coalesce(F.array_join(F.transform(keep, lambda a: a["name"]), "; "), F.lit("")).alias("persons"), F.when(F.col("authors").isNull(), 0).otherwise(n).cast("bigint").alias("corporate"))


@query("""select record_id, source || ':' || source_id as notice_id, substring(sha1(concat_ws('\x1f', coalesce(title, '\x00'), coalesce(left(abstract, 1200), '\x00'), coalesce(cast(year as varchar), '\x00'))), 1, 16) as digest from corpus""")
def notice_digest(spark: SparkSession, d: str) -> DataFrame:
    """Identifier of each notice and the digest of what a classifier would read."""
    c = table(spark, d, "corpus")
    return c.select("record_id", ids.notice_identifier(F.col("source"), F.col("source_id"), F.col("title"), F.lit(None).cast("string"), F.col("year")).alias("notice_id"), ids.payload_digest(F.col("title"), F.substring("abstract", 1, 1200), F.col("year")).alias("digest"))
