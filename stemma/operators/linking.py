"""Guarded record linkage: DOI, anchored fuzzy blocks, ISBN, and a guarded union.

All candidate edges are known before any union is made, and two components of the
candidate graph never meet, so the ordered, stateful union runs per component: the
edges of a component are replayed in their order by one task.  Components stay
small, as blocks over ``MAX_BLOCK`` rows and ISBNs over ``MAX_TITLES`` titles make no
edges, and before the replay every DOI class and every set of ISBN copies is one node.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import codes, ids, text
from stemma.operators.components import connected_components
from stemma.session import materialize

MAX_BLOCK = 6
MAX_TITLES = 6
TITLE_KEY = 80
STRONG_TITLE = 25
YEAR_GAP = 1


def keyed(records: DataFrame) -> DataFrame:
    """Records with the keys of linkage; ``row_id`` orders rows by content, not by file."""
    return records.select(
        "record_id",
        ids.norm_doi(F.col("doi")).alias("doi"),
        text.norm_title(F.col("title")).alias("title_norm"),
        ids.first_author_key(F.col("authors")).alias("author_key"),
        ids.volume_signature(F.col("title")).alias("volume"),
        codes.norm_year(F.col("year")).alias("year"),
        ids.record_isbns(F.col("isbn"), F.col("isbn_issn")).alias("isbns"),
        "source",
        "source_id",
    )


def doi_edges(k: DataFrame) -> DataFrame:
    """Every row to the first row of its DOI."""
    first = k.where("doi is not null").groupBy("doi").agg(F.min("record_id").alias("i"))
    return k.join(first, "doi").where("record_id != i").select("i", F.col("record_id").alias("j"))


def blocks(k: DataFrame) -> DataFrame:
    """Rows of fuzzy blocks: same 80 characters of title, author key and volume, at most MAX_BLOCK rows."""
    b = k.where("title_norm != ''").withColumn("block", F.concat_ws("|", F.substring("title_norm", 1, TITLE_KEY), F.coalesce("author_key", F.lit("")), F.to_json("volume")))
    # size is counted before rows are gathered: a hot block never reaches one task
    size = b.groupBy("block").agg(F.count("*").alias("size"), F.count_distinct("title_norm").alias("titles"), F.max(F.length("title_norm")).alias("length"))
    return b.join(size.where(f"size between 2 and {MAX_BLOCK}"), "block")


def anchored(b: DataFrame) -> DataFrame:
    """(block, record_id, anchor): the row every row of a block is tied to.

    The anchor of a dated row is the oldest row opened so far no more than a year
    before it; undated rows are tied to the first undated one.  Blocks are bounded,
    so one fold over the sorted years of a block does it.
    """
    s = b.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.col("year").isNull().alias("undated"), F.coalesce("year", F.lit(0)).alias("year"), "record_id"))).alias("rows"), F.first("titles").alias("titles"), F.first("length").alias("length"))
    fold = F.expr(
        """aggregate(rows, cast(named_struct('open', array(), 'out', array()) as struct<open:array<struct<year:int,undated:boolean,rep:bigint>>,out:array<struct<record_id:bigint,anchor:bigint,ord:int>>>),
        (s, r) -> named_struct(
          'open', if(exists(s.open, o -> o.undated = r.undated and (r.undated or r.year - o.year <= 1)), s.open, concat(s.open, array(named_struct('year', r.year, 'undated', r.undated, 'rep', r.record_id)))),
          'out', concat(s.out, array(named_struct('record_id', r.record_id, 'anchor', coalesce(get(filter(s.open, o -> o.undated = r.undated and (r.undated or r.year - o.year <= 1)), 0).rep, r.record_id), 'ord', size(s.out))))),
        s -> s.out)"""
    )
    return s.select("block", "titles", "length", F.explode(fold).alias("x")).select("block", "titles", "length", "x.*")


def fuzzy_edges(b: DataFrame) -> DataFrame:
    a = anchored(b).where("record_id != anchor")
    return a.select(F.col("anchor").alias("i"), F.col("record_id").alias("j"), F.col("block").alias("order_key"), F.col("ord").alias("seq"), ((F.col("titles") == 1) & (F.col("length") >= STRONG_TITLE)).alias("strong"))


def isbn_pairs(k: DataFrame) -> DataFrame:
    """Pairs under one ISBN with the verdict: linked, year_gap, volume_marker; series ISBNs make none."""
    e = k.select("record_id", "title_norm", "volume", "year", F.explode("isbns").alias("isbn"))
    # distinct titles are counted first: the ISBN of a series, however many rows it has, pairs nothing
    ok = e.groupBy("isbn").agg(F.count_distinct(F.substring(F.coalesce("title_norm", F.lit("")), 1, TITLE_KEY)).alias("titles"), F.count("*").alias("n")).where(f"n > 1 and titles <= {MAX_TITLES}").select("isbn")
    e = e.join(ok, "isbn")
    # copies of one title and year count once; the rest are tied to their first row
    first = e.groupBy("isbn", "title_norm", "year").agg(F.min("record_id").alias("record_id"), F.min("volume").alias("volume"))
    l, r = first.alias("l"), first.alias("r")
    p = l.join(r, F.col("l.isbn") == F.col("r.isbn")).where("l.record_id < r.record_id")
    gap = F.coalesce(F.abs(F.col("l.year") - F.col("r.year")) > YEAR_GAP, F.lit(False))
    vol = (F.size("l.volume") > 0) & (F.size("r.volume") > 0) & (F.col("l.volume") != F.col("r.volume"))
    p = p.select(F.col("l.isbn").alias("isbn"), F.col("l.record_id").alias("i"), F.col("r.record_id").alias("j"), gap.alias("gap"), vol.alias("vol"), F.col("l.title_norm").alias("a"), F.col("r.title_norm").alias("b"))
    p = p.withColumn("same", ids.same_designation(F.col("a"), F.col("b")))
    out = p.select("isbn", "i", "j", F.when(F.col("gap"), "year_gap").when(F.col("vol") & ~F.col("same"), "volume_marker").otherwise("linked").alias("verdict"))
    e1 = e.alias("e")
    copies = e1.join(first.alias("f"), (F.col("e.isbn") == F.col("f.isbn")) & F.col("e.title_norm").eqNullSafe(F.col("f.title_norm")) & F.col("e.year").eqNullSafe(F.col("f.year"))).where("e.record_id != f.record_id")
    return out.unionByName(copies.select(F.col("e.isbn").alias("isbn"), F.col("f.record_id").alias("i"), F.col("e.record_id").alias("j"), F.lit("linked").alias("verdict")))


def isbn_series(k: DataFrame) -> DataFrame:
    """(isbn, titles) of the ISBNs that name a series, not a volume."""
    e = k.select(F.explode("isbns").alias("isbn"), F.substring(F.coalesce("title_norm", F.lit("")), 1, TITLE_KEY).alias("t"))
    return e.groupBy("isbn").agg(F.count_distinct("t").alias("titles")).where(f"titles > {MAX_TITLES}")


class GuardedUnion:
    """Union of nodes whose DOI, registrant and volume sets must not contradict each other."""

    def __init__(self, state: dict):
        self.parent = {n: n for n in state}
        self.state = {n: tuple(map(set, s)) for n, s in state.items()}

    def find(self, n):
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def join(self, i, j, strong: bool) -> str:
        a, b = self.find(i), self.find(j)
        if a == b:
            return "joined"
        (da, pa, va), (db, pb, vb) = self.state[a], self.state[b]
        if da and db and da != db:
            if not strong:
                return "doi"
            if pa & pb:
                return "registrant"
            if va != vb:
                return "volume"
        low, high = min(a, b), max(a, b)
        self.parent[high] = low
        self.state[low] = (da | db, pa | pb, va | vb)
        return "linked"


def cluster(records: DataFrame) -> DataFrame:
    """(record_id, cluster): the least record of the cluster each row falls into."""
    k = materialize(keyed(records), "keyed")
    doi = doi_edges(k)
    fuzzy = fuzzy_edges(blocks(k)).select("i", "j", F.lit(2).alias("phase"), "order_key", "seq", "strong")
    isbn = isbn_pairs(k).where("verdict = 'linked'").select("i", "j", F.lit(3).alias("phase"), F.col("isbn").alias("order_key"), F.xxhash64("i", "j").alias("_"), F.lit(True).alias("strong"))
    isbn = isbn.withColumn("seq", F.row_number().over(Window.partitionBy("order_key").orderBy("i", "j"))).drop("_")
    # a DOI class is one node from the start, and so are copies without a DOI under one ISBN: their
    # links are unconditional, and however many they are, they reach the replay as one row
    by_doi = k.where("doi is not null").groupBy("doi").agg(F.min("record_id").alias("by_doi"))
    # (an ISBN that names a series unites nothing, so rows that have no other are no copies of each other)
    of_volume = k.where("doi is null").select("record_id", F.explode("isbns").alias("isbn")).join(isbn_series(k).select("isbn"), "isbn", "left_anti").select("record_id").distinct()
    copy_key = F.when(F.col("one_volume") & F.col("doi").isNull(), F.xxhash64(F.to_json("isbns"), "title_norm", "author_key", F.to_json("volume"), "year"))
    k2 = k.join(of_volume.withColumn("one_volume", F.lit(True)), "record_id", "left").select("record_id", "doi", "volume", copy_key.alias("copy"))
    by_copy = k2.where("copy is not null").groupBy("copy").agg(F.min("record_id").alias("by_copy"))
    home = k2.join(by_doi, "doi", "left").join(by_copy, "copy", "left").select("record_id", F.coalesce("by_doi", "by_copy", "record_id").alias("node"), "doi", "volume")
    home = materialize(home, "home")
    at = lambda c: home.select(F.col("record_id").alias(c), F.col("node").alias(f"n{c}"))
    edges = fuzzy.unionByName(isbn).join(at("i"), "i").join(at("j"), "j").where("ni != nj").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "phase", "order_key", "seq", "strong")
    edges = materialize(edges, "edges")
    comp = materialize(connected_components(edges, "i", "j"), "components")
    state = home.groupBy("node").agg(F.collect_set("doi").alias("dois"), F.array_distinct(F.flatten(F.collect_set("volume"))).alias("volumes")).join(comp, "node")
    ev = edges.join(comp.withColumnRenamed("node", "i"), "i").select("component", "phase", "order_key", "seq", "i", "j", "strong", F.lit(None).cast("array<string>").alias("dois"), F.lit(None).cast("array<int>").alias("volumes"))
    st = state.select("component", F.lit(0).alias("phase"), F.lit("").alias("order_key"), F.lit(0).alias("seq"), F.col("node").alias("i"), F.col("node").alias("j"), F.lit(False).alias("strong"), "dois", "volumes")

    def replay(df: pd.DataFrame) -> pd.DataFrame:
        nodes = df[df.phase == 0]
        u = GuardedUnion({int(n): (set(d), {x.split("/")[0] for x in d}, set(map(int, v))) for n, d, v in zip(nodes.i, nodes.dois, nodes.volumes)})
        for e in df[df.phase > 0].sort_values(["phase", "order_key", "seq"]).itertuples():
            u.join(int(e.i), int(e.j), bool(e.strong))
        return pd.DataFrame({"node": list(u.parent), "cluster": [u.find(n) for n in u.parent]})

    # only a second DOI can refuse a link: components without one are one cluster as they are, whatever
    # their size, and the links are replayed in order only where there are two DOIs or more
    contested = materialize(st.select("component", F.explode("dois").alias("doi")).groupBy("component").agg(F.count_distinct("doi").alias("n")).where("n > 1").select("component"), "contested")
    settled = comp.join(contested, "component", "left_anti").select("node", F.col("component").alias("cluster"))
    joined = ev.unionByName(st).join(contested, "component", "left_semi").groupBy("component").applyInPandas(replay, "node bigint, cluster bigint").unionByName(settled)
    top = home.join(joined, "node", "left").select("record_id", "node", F.coalesce("cluster", "node").alias("c"))
    least = top.groupBy("c").agg(F.min("record_id").alias("cluster"))
    return top.join(least, "c").select("record_id", "cluster")
