"""Pages of bibliographic services, as recorded, mapped to the one record shape.

Each mapper takes a table with a text column ``page`` (one JSON answer per row, as the
service gave it) and gives one row per record in it, in the columns of
:data:`stemma.sources.readers.RECORD`.  Everything is a column expression over a declared
schema, so unknown members of an answer are never materialised.

Defined cases: a null page, one that is no JSON, and one without records give no rows;
a member that is missing is null; records without an identifier are dropped; names
without a letter are left out of ``authors``; other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stemma.functions import ids, text
from stemma.sources.readers import RECORD

_AUTHOR = "array<struct<name:string,role:string,type:string,gnd:string>>"


def _records(pages: DataFrame, schema: str, member: str) -> DataFrame:
    page = pages.select(F.from_json("page", schema)[member].alias("all"))
    return page.select(F.explode("all").alias("r")).select("r.*")


def _shape(df: DataFrame, source: str, **given: Column) -> DataFrame:
    cols = {"source": F.lit(source), **given}
    out = df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RECORD)])
    return out.where(F.trim("source_id") != "")


def _people(names: Column) -> Column:
    """Authors of plain names; each name once, blanks squeezed."""
    kept = F.array_distinct(F.filter(F.transform(names, text.squeeze), lambda n: n.rlike(r"\p{L}")))
    return F.transform(kept, lambda n: F.struct(n.alias("name"), F.lit("aut").alias("role"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("gnd"))).cast(_AUTHOR)


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


_OPENALEX = """results array<struct<id:string,doi:string,display_name:string,title:string,publication_year:int,language:string,type:string,
    authorships:array<struct<author:struct<display_name:string>,raw_author_name:string>>,
    primary_location:struct<source:struct<display_name:string>>,abstract_inverted_index:map<string,array<int>>>>"""


def openalex(pages: DataFrame) -> DataFrame:
    """Works of the OpenAlex API: the abstract is put together from its inverted index."""
    r = _records(pages, _OPENALEX, "results")
    abstract = _filled(text.inverted_to_text(F.col("abstract_inverted_index")))
    names = F.transform("authorships", lambda a: F.coalesce(_filled(a["author"]["display_name"]), a["raw_author_name"]))
    return _shape(
        r, "openalex", source_id=F.col("id"), doi=ids.norm_doi(F.col("doi")), title=F.coalesce(_filled(F.col("display_name")), F.col("title")), authors=_people(names), year=F.col("publication_year"), language=F.col("language"),
        container=F.col("primary_location.source.display_name"), type=F.col("type"), url=F.col("id"), abstract=abstract, abstract_rights=F.when(abstract.isNotNull(), "openalex-inverted"),
    )


_DATE = "struct<`date-parts`:array<array<int>>>"
_CROSSREF = f"""message struct<items:array<struct<DOI:string,title:array<string>,`container-title`:array<string>,language:string,type:string,URL:string,abstract:string,ISBN:array<string>,
    author:array<struct<given:string,family:string,name:string>>,issued:{_DATE},`published-print`:{_DATE},`published-online`:{_DATE},created:{_DATE}>>>"""


def crossref(pages: DataFrame) -> DataFrame:
    """Works of the Crossref API: the year is that of the first date that has one; markup leaves the abstract."""
    page = pages.select(F.from_json("page", _CROSSREF)["message"]["items"].alias("all"))
    r = page.select(F.explode("all").alias("r")).select("r.*")
    names = F.transform("author", lambda a: F.coalesce(_filled(F.concat_ws(" ", a["given"], a["family"])), a["name"]))
    year = F.coalesce(*[F.get(F.get(F.col(f"`{d}`.`date-parts`"), F.lit(0)), F.lit(0)) for d in ("issued", "published-print", "published-online", "created")])
    abstract = text.strip_tags(F.col("abstract"))
    return _shape(
        r, "crossref", source_id=F.col("DOI"), doi=F.lower("DOI"), title=F.get("title", F.lit(0)), authors=_people(names), year=year, language=F.col("language"), container=F.get("`container-title`", F.lit(0)), type=F.col("type"),
        url=F.col("URL"), isbn=F.col("ISBN"), abstract=abstract, abstract_rights=F.when(abstract.isNotNull(), "crossref-jats"),
    )


_SCHOLAR = """data array<struct<paperId:string,title:string,abstract:string,venue:string,year:int,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,publicationTypes:array<string>>>"""


def semantic_scholar(pages: DataFrame) -> DataFrame:
    """Papers of the Semantic Scholar search, both of its offset and of its token pages."""
    r = _records(pages, _SCHOLAR, "data")
    return _shape(
        r, "semanticscholar", source_id=F.col("paperId"), doi=ids.norm_doi(F.col("externalIds.DOI")), title=F.col("title"), authors=_people(F.col("authors.name")), year=F.col("year"), container=_filled(F.col("venue")), type=F.get("publicationTypes", F.lit(0)),
        url=F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paperId"), abstract=F.col("abstract"), abstract_rights=F.when(F.col("abstract").isNotNull(), "s2-odc-by"),
    )


_SBN = "briefRecords array<struct<codiceIdentificativo:string,titolo:string,autorePrincipale:string,nomi:array<string>,pubblicazione:string,livello:string,tipo:string>>"


def sbn(pages: DataFrame) -> DataFrame:
    """Brief records of the SBN catalogue: a mark of role before a name goes, the imprint gives the year."""
    r = _records(pages, _SBN, "briefRecords")
    key = F.replace(F.replace("codiceIdentificativo", F.lit("IT\\ICCU\\"), F.lit("")), F.lit("\\"), F.lit(""))
    names = F.concat(F.array("autorePrincipale"), F.coalesce(F.transform("nomi", lambda n: F.regexp_replace(n, r"^\s*\[[^\]]*\]\s*", "")), F.array().cast("array<string>")))
    year = F.regexp_extract("pubblicazione", r"\b(1[4-9][0-9]{2}|20[0-9]{2})\b", 1).try_cast("int")
    return _shape(r, "sbn", source_id=key, title=F.col("titolo"), authors=_people(names), year=year, container=F.col("pubblicazione"), type=_filled(F.concat_ws(" / ", _filled(F.col("livello")), _filled(F.col("tipo")))))


_PERSON = "array<struct<nom:string,prenom:string>>"
_THESES = f"theses array<struct<nnt:string,id:string,titrePrincipal:string,titreEN:string,auteurs:{_PERSON},dateSoutenance:string,etabSoutenanceN:string,resumes:struct<fr:string,en:string>>>"


def theses_fr(pages: DataFrame) -> DataFrame:
    """Theses of theses.fr: the year ends the date of the defence; an English summary alone makes the language English."""
    r = _records(pages, _THESES, "theses")
    fr, en = _filled(F.col("resumes.fr")), _filled(F.col("resumes.en"))
    key = F.coalesce(_filled(F.col("nnt")), F.col("id"))
    return _shape(
        r, "thesesfr", source_id=key, title=F.coalesce(_filled(F.col("titrePrincipal")), F.col("titreEN")), authors=_people(F.transform("auteurs", lambda a: F.concat_ws(" ", a["nom"], a["prenom"]))), year=F.regexp_extract("dateSoutenance", r"([0-9]{4})$", 1).try_cast("int"),
        language=F.when(fr.isNull() & en.isNotNull(), "en").otherwise("fr"), container=_filled(F.col("etabSoutenanceN")), type=F.lit("these"), url=F.concat(F.lit("https://theses.fr/"), key), abstract=F.coalesce(fr, en), relation=F.lit("about"),
    )


def rss_ids(pages: DataFrame, pattern: str = r"/Record/([0-9]{6,10}[0-9Xx])\b") -> DataFrame:
    """(source_id): the record numbers in the links of RSS pages, each once."""
    links = F.regexp_extract_all("page", F.lit(r"(?s)<(?:link|guid)[^>]*>\s*(.*?)\s*</(?:link|guid)>"), 1)
    return pages.select(F.explode(links).alias("link")).select(F.upper(F.regexp_extract("link", pattern, 1)).alias("source_id")).where("source_id != ''").distinct()


#: mapper by name of the service
MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openalex": openalex, "crossref": crossref, "semanticscholar": semantic_scholar, "sbn": sbn, "thesesfr": theses_fr}
