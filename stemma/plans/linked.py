"""Linkage, golden records, stable ids, graph and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import codes, ids, text
from stemma.operators import golden, graph, linking, tags
from stemma.operators.components import connected_components
from stemma.plans import sqltext as S
from stemma.plans.base import current, register
from stemma.session import materialize, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

_DOI = f"(select record_id, {S.norm_doi('doi')} as doi, source, source_id from corpus)"


@query(f"select f.i, r.record_id as j from {_DOI} r join (select doi, min(record_id) as i from {_DOI} where doi is not null group by 1) f using (doi) where r.record_id <> f.i")
def doi_self_link(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "corpus").select("record_id", ids.norm_doi(F.col("doi")).alias("doi"))
    return linking.doi_edges(k)


@query(f"""with recursive l as (select distinct * from (select record_id as a, min(record_id) over (partition by doi) as b from {_DOI} where doi is not null union all select record_id, min(record_id) over (partition by source, source_id) from corpus)),
    e as (select a, b from l where a <> b union select b, a from l where a <> b), w(node, least) as (select a, a from e union select e.b, w.least from w join e on e.a = w.node where w.least < e.b)
    select node, least(min(least), node) as component from w group by node""")
def doi_and_key_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of rows tied by a DOI or by their natural key."""
    c = table(spark, d, "corpus").select("record_id", ids.norm_doi(F.col("doi")).alias("doi"), F.concat_ws("\x1f", "source", "source_id").alias("k"))
    by = lambda key: c.where(F.col(key).isNotNull()).join(c.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("record_id").alias("a")), key).select("a", F.col("record_id").alias("b"))
    return connected_components(by("doi").unionByName(by("k")), "a", "b")


_BL = f"(select record_id, {S.norm_title('title')} as t, coalesce(authors[1].name, '') as a, year from corpus)"


@query(f"""with b as (select *, t || '|' || a as block from {_BL} where t <> '') select block, record_id, year, n from (select *, count(*) over (partition by block) as n from b) where n between 2 and 6""")
def fuzzy_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of equal title and first author with two to six rows."""
    c = table(spark, d, "corpus").select("record_id", text.norm_title(F.col("title")).alias("t"), F.coalesce(F.get("authors", F.lit(0))["name"], F.lit("")).alias("a"), "year").where("t != ''")
    b = c.withColumn("block", F.concat("t", F.lit("|"), "a"))
    n = b.groupBy("block").agg(F.count("*").alias("n")).where("n between 2 and 6")
    return b.join(n, "block").select("block", "record_id", "year", "n")


_AN = f"""with recursive b as (select *, t || '|' || a as block from {_BL} where t <> ''), s as (select block, record_id, year, row_number() over (partition by block order by year is null, year, record_id) as k, count(*) over (partition by block) as n from b),
    x as (select * from s where n between 2 and 6),
    w(block, k, record_id, year, anchor, anchor_year) as (select block, k, record_id, year, record_id, year from x where k = 1
      union all select x.block, x.k, x.record_id, x.year,
        case when (x.year is null and w.anchor_year is null) or (x.year is not null and w.anchor_year is not null and x.year - w.anchor_year <= 1) then w.anchor else x.record_id end,
        case when (x.year is null and w.anchor_year is null) or (x.year is not null and w.anchor_year is not null and x.year - w.anchor_year <= 1) then w.anchor_year else x.year end
      from w join x on x.block = w.block and x.k = w.k + 1)
    select record_id, anchor from w"""


@query(_AN)
def anchored_years(spark: SparkSession, d: str) -> DataFrame:
    """The oldest row each row of a block is tied to: at most a year before it, never chained."""
    b = fuzzy_blocks(spark, d).withColumn("titles", F.lit(1)).withColumn("length", F.lit(0))
    return linking.anchored(b).select("record_id", "anchor")


@query()
def isbn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs under one ISBN and the verdict; checked by unit tests."""
    return linking.isbn_pairs(materialize(linking.keyed(table(spark, d, "corpus")), "keyed"))


@query()
def guarded_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the guarded union; checked against a sequential union in tests."""
    return linking.cluster(table(spark, d, "corpus"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows by DOI class with the trust of their source."""
    c = table(spark, d, "corpus").withColumn("cluster", ids.norm_doi(F.col("doi"))).where("cluster is not null")
    p = table(spark, d, "source_policy").select("source", "trust_rank")
    return c.join(F.broadcast(p), "source", "left").withColumn("priority", F.coalesce("trust_rank", F.lit(99)))  # the policy is a fixed table


_RK = f"(select c.*, {S.norm_doi('c.doi')} as cluster, coalesce(p.trust_rank, 99) as priority from corpus c left join source_policy p using (source))"


def _first(col: str) -> str:
    return f"arg_min({col}, (priority, record_id)) filter (where {col} is not null and trim(cast({col} as varchar)) <> '')"


def _from(col: str) -> str:
    return f"coalesce(arg_min(source || ':' || source_id, (priority, record_id)) filter (where {col} is not null and trim(cast({col} as varchar)) <> ''), '')"


@query(f"""select cluster, count(*) as n_rows, {_first('title')} as title, {_from('title')} as title_from, {_first('year')} as year, {_from('year')} as year_from, {_first('container')} as container, {_from('container')} as container_from,
    {_first('abstract')} as abstract, {_from('abstract')} as abstract_from from {_RK} where cluster is not null group by 1""")
def golden_record(spark: SparkSession, d: str) -> DataFrame:
    m = golden.merge(_ranked(spark, d), "cluster", "priority", ["record_id"])
    return m.select("cluster", "n_rows", "title", "title_from", "year", "year_from", "container", "container_from", "abstract", "abstract_from")


def _vk(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower(cast({x} as varchar)), '\\s+', ' ', 'g')), '[.,;:\\s]+$', '')"


@query(
    "with k as (select * from " + _RK + " where cluster is not null), " + ", ".join(f"w_{c} as (select cluster, {_first(c)} as won from k group by 1)" for c in ("year", "container", "language", "type"))
    + " select field, count(*) as n from (" + " union all ".join(f"select '{c}' as field from k join w_{c} using (cluster) where {c} is not null and trim(cast({c} as varchar)) <> '' and {_vk(c)} <> {_vk('won')}" for c in ("year", "container", "language", "type")) + ") group by 1"
)
def conflicts_by_field(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d)
    fields = ("year", "container", "language", "type")
    m = golden.merge(rows, "cluster", "priority", ["record_id"], fields)
    return golden.conflicts(rows, m, "cluster", fields).groupBy("field").agg(F.count("*").alias("n"))


@query(f"""select cluster, count(*) as texts, max(rights) as rights from (select cluster, trim(abstract) as t, count(distinct abstract_rights) as rights from {_RK} where cluster is not null and trim(coalesce(abstract, '')) <> '' group by 1, 2 having count(distinct abstract_rights) > 1) group by 1""")
def rights_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return golden.rights_conflicts(_ranked(spark, d), "cluster")


@query(f"select cluster, 'W' || substring(sha1('doi:' || cluster), 1, 12) as stable_id from (select distinct {S.norm_doi('doi')} as cluster from corpus) where cluster is not null")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    m = golden.merge(_ranked(spark, d), "cluster", "priority", ["record_id"], ("title", "year"))
    m = m.select("cluster", F.col("cluster").alias("doi"), text.norm_title(F.col("title")).alias("title_key"), "year", F.lit(None).cast("string").alias("author_key"), "sources")
    return golden.assert_unique(golden.stable_ids(m).select("cluster", "stable_id"), "stable_id")


@query(f"""select isbn, clusters, case when volumes > 1 then 'volume' when hi - lo > 1 then 'reissue' else 'unexplained' end as why from (select isbn, count(distinct coalesce(doi, cast(record_id as varchar))) as clusters, count(distinct volume) as volumes, min(year) lo, max(year) hi from
    (select c.record_id, unnest(c.isbn) as isbn, c.year, {S.norm_doi('c.doi')} as doi, regexp_extract({S.norm_title('c.title')}, '(?:^| )(?:vol|band|tome|tomo|tom|том|τομοσ) ([ivxlc]+|[0-9]{{1,3}})(?: |$)', 1) as volume from corpus c) group by 1) where clusters > 1""")
def isbn_split_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    from stemma.operators.gates import isbn_splits

    c = table(spark, d, "corpus")
    vol = F.regexp_extract(text.norm_title(F.col("title")), "(?:^| )(?:vol|band|tome|tomo|tom|том|τομοσ) ([ivxlc]+|[0-9]{1,3})(?: |$)", 1)
    x = c.select(F.explode("isbn").alias("isbn"), F.coalesce(ids.norm_doi(F.col("doi")), F.col("record_id").cast("string")).alias("cluster"), "year", F.coalesce(vol, F.lit(None)).alias("volume"))
    return isbn_splits(x).select("isbn", "clusters", "why")


@query("""with p as (select record_id, unnest(sources) as s from corpus), o as (select distinct record_id as old_id, s.source as source, s.source_id as source_id from p), n as (select source, source_id, min(record_id) as new_id from corpus group by 1, 2)
    select old_id, new_id, count(*) as shared from o join n using (source, source_id) group by 1, 2""")
def id_remap_votes(spark: SparkSession, d: str) -> DataFrame:
    """Old clusters (a row's source pairs) against new ones (a pair's first row)."""
    c = table(spark, d, "corpus")
    old = c.select(F.col("record_id").alias("cluster"), F.explode("sources").alias("s")).select("cluster", "s.source", "s.source_id")
    new = c.groupBy("source", "source_id").agg(F.min("record_id").alias("cluster"))
    return tags.remap_votes(old, new)


@query("""with p as (select record_id, unnest(sources) as s from corpus), o as (select distinct record_id as old_id, s.source as source, s.source_id as source_id from p), n as (select source, source_id, min(record_id) as new_id from corpus group by 1, 2),
    v as (select old_id, new_id, count(*) as shared from o join n using (source, source_id) group by 1, 2), t as (select old_id, count(*) as targets from v group by 1)
    select v.new_id, min(v.old_id) as old_id from v join t using (old_id) where t.targets = 1 group by 1""")
def id_remap_unique(spark: SparkSession, d: str) -> DataFrame:
    """Old ids with one target, one old id per target."""
    votes = id_remap_votes(spark, d)
    one = votes.groupBy("old_id").agg(F.count("*").alias("k")).where("k = 1").select("old_id")
    return tags.remap(votes.join(one, "old_id")).select("new_id", "old_id")


# -------------------------------------------------------------------- graph
_EDGES = f"""(with p as (select c.notice_id, c.container, c.authors from {S.CURRENT} c join {S.LATEST} l using (notice_id) where l.relevance in ('core', 'partial', 'marginal')),
    a as (select distinct notice_id as src, 'author:' || n as dst, 'author' as rel from (select notice_id, {S.norm_title('x.name')} as n from (select notice_id, unnest(authors) as x from p)) where n <> ''),
    c as (select distinct notice_id as src, 'container:' || n as dst, 'container' as rel from (select notice_id, {S.norm_title('container')} as n from p) where n <> '')
    select * from a union all select * from c where dst in (select dst from c group by 1 having count(*) >= 5))"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = tags.latest(table(spark, d, "tag_log")).where(tags.relevance_at_least(F.col("relevance"), "marginal")).select("notice_id")
    p = current(spark, d, "container", "authors").join(t, "notice_id")
    a = p.select("notice_id", F.explode("authors.name").alias("n")).select("notice_id", text.norm_title(F.col("n")).alias("key"))
    c = p.select("notice_id", text.norm_title(F.col("container")).alias("key"))
    return graph.edges(a, "notice_id", "key", "author").unionByName(graph.edges(c, "notice_id", "key", "container", 5))


@query(f"select * from {_EDGES}")
def bipartite_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"select src as node, 'pub' as kind, count(*) as degree from {_EDGES} group by 1 union all select dst, rel, count(*) from {_EDGES} group by 1, 2")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(materialize(_edges(spark, d), "edges"))


@query()
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """45 rounds, damping 0.85, mass of isolated nodes not dealt out; checked against a plain loop in tests."""
    return graph.pagerank(_edges(spark, d))


_ADJ = f"(select a.t as a, b.t as b, count(*) as weight from (select notice_id, unnest(list_distinct(themes)) as t from {S.LATEST}) a join (select notice_id, unnest(list_distinct(themes)) as t from {S.LATEST}) b on a.notice_id = b.notice_id and a.t < b.t group by 1, 2 having count(*) >= 4)"


@query(f"select * from {_ADJ}")
def adjacency_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence(tags.latest(table(spark, d, "tag_log")), "notice_id", "themes", 4)


@query(f"select a, b, weight, rank from (select *, row_number() over (partition by a order by weight desc, b) as rank from (select a, b, weight from {_ADJ} union all select b, a, weight from {_ADJ})) where rank <= 3")
def adjacency_trails(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_trails(adjacency_links(spark, d)).select("a", "b", "weight", "rank")


@query(f"select b as zone, cast(sum(weight) as bigint) as weight from (select a, b, weight from {_ADJ} union all select b, a, weight from {_ADJ}) where a in ('prayer', 'kenosis') and b not in ('prayer', 'kenosis') group by 1 order by 2 desc, 1 limit 3")
def adjacent_zones(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent_zones(adjacency_links(spark, d), ["prayer", "kenosis"])


_WT = f"(select w, t, count(*) as n from (select notice_id, t, unnest(list_distinct(works)) as w from (select notice_id, works, unnest(list_distinct(themes)) as t from {S.LATEST})) group by 1, 2)"


@query(f"select l.w as a, r.w as b, cast(sum(least(l.n, r.n)) as bigint) as weight from {_WT} l join {_WT} r on l.t = r.t and l.w < r.w group by 1, 2 having sum(least(l.n, r.n)) >= 3")
def work_min_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = tags.latest(table(spark, d, "tag_log")).select("notice_id", F.explode(F.array_distinct("themes")).alias("theme"), "works").select("notice_id", "theme", F.explode(F.array_distinct("works")).alias("work"))
    return graph.min_overlap(t, "work", "theme", 3)


@query(f"select name_key, numbers from (select {S.norm_title('x.name')} as name_key, count(distinct x.gnd) as numbers from (select unnest(authors) as x from corpus) where x.gnd is not null group by 1) where numbers > 1")
def author_homonyms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "corpus").select(F.explode("authors").alias("x")).select(text.norm_title(F.col("x.name")).alias("name_key"), "x.gnd")
    return graph.homonyms(a)



