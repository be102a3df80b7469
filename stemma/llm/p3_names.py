"""Variant spellings of names: which entity of the authority file a mention stands for.

Method: merge-and-rematch.  Every mention is read into a form (surname, given
names and initials, or the words and place of an organisation); equal forms are
counted once.  Each authority entity starts a profile with its own form.  In every
round the forms that the profiles changed last meet in blocking (equal surname, or one
edit apart through deletion neighbourhoods) are compared with all that the profile
holds, and each form that fits one profile best is merged into it: its spelling, its
given names and initials, or an organisation's words and acronym, join the profile, and
every profile that gained any of these enters blocking again with all its spellings.
So a misspelled surname first accepted with the full given name is then accepted with
an initial, and a second given name learned from one form decides between two persons of
one initial or speaks against a third.  Forms that only an initial speaks for wait until
no fuller form merges any more.  Rounds go on until none merges anything.  Mentions
whose initials also fit a person who is not in the file are settled by the other rows of
the same publication.

Forms of a surname that no chain of single edits through the spellings of the corpus ties
to the file are not compared; no round can reach them.  The authority file is a fixed
table; forms and mentions are only ever joined by key.  A hot name is one form, whatever
the number of its mentions.

Defined cases: null names, null author lists and an empty table give no rows; a
name that fits two entities equally well stands for none; mentions that are the
preferred name to the letter are left out of ``found``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import names
from stemma.llm.names import givens_match, near, org_match, profile_match
from stemma.llm.records import LIST, NATURAL_KEYS, PART, PLAIN_DOI, h64
from stemma.session import materialize, scratch

_MENTION = pa.schema([
    ("record_id", pa.int64()), ("author_pos", pa.int32()), ("name", pa.string()), ("gnd", pa.string()), ("form", pa.int64()), ("kind", pa.string()),
    ("surname", pa.string()), ("givens", pa.list_(pa.string())), ("initials", pa.string()), ("words", pa.list_(pa.string())),
])
_MENTION_SQL = "record_id bigint, author_pos int, name string, gnd string, form bigint, kind string, surname string, givens array<string>, initials string, words array<string>, ctx array<bigint>"
_AUTH_SQL = "entity_id bigint, kind string, surname string, givens array<string>, initials string, words array<string>, parts array<string>"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _MENTION]
        at: list[int] = []
        cols = [batch.column(i).to_pylist() for i in (0, 2)]
        for k, (rid, people) in enumerate(zip(*cols)):
            for i, a in enumerate(people.split(LIST)):
                name, kind, gnd = a.split(PART)
                f, key = _read(name, kind or None)
                if f is None:
                    continue
                at.append(k)
                for c, v in zip(out, (rid, i, name, gnd or None, key, f.kind, f.surname, f.givens, f.initials, f.words)):
                    c.append(v)
        ctx = batch.column(1).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, _MENTION)), ctx], names=[*_MENTION.names, "ctx"])


@lru_cache(maxsize=100_000)
def _read(name: str, kind: str | None):
    f = names.parse(name, kind)
    return f, (h64("\x1f".join([f.kind, f.surname, *f.givens, "=", f.initials, *f.words])) if f else 0)


# the flattened form keeps the position of every author; unnamed ones are empty and read as none
_PEOPLE = "array_join(transform(authors, a -> concat(translate(coalesce(a.name, ''), '\x1e\x1f', ''), '\x1f', coalesce(a.type, ''), '\x1f', coalesce(a.gnd, ''))), '\x1e')"


def mentions(corpus: DataFrame) -> DataFrame:
    """One row per author mention, read into its form, with the keys of its publication."""
    doi = F.expr(f"case when {PLAIN_DOI} is not null then xxhash64({PLAIN_DOI}) end")
    plain = "trim(regexp_replace(lower(title), '[^\\\\p{L}\\\\p{N}]+', ' '))"
    title = F.expr(f"case when {plain} like '% % % %' then xxhash64({plain}, 't') end")
    keys = F.array_compact(F.concat(F.expr(NATURAL_KEYS), F.array(doi, title)))
    return corpus.where("size(authors) > 0").select("record_id", keys.alias("ctx"), F.expr(_PEOPLE).alias("people")).mapInArrow(_mentions, _MENTION_SQL)


def _authority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            f = names.parse(r["pref_name"], "corporate" if r["entity_kind"] == "corporate" else "person")
            if f is None:
                continue
            parts = []
            if f.kind == "person" and r["pref_name"]:
                parts = [k for k in map(names.surname_key, r["pref_name"].split(",")[0].split("-")) if k != f.surname and len(k) > 3]
            rows.append({"entity_id": r["entity_id"], "kind": f.kind, "surname": f.surname, "givens": list(f.givens), "initials": f.initials, "words": list(f.words), "parts": parts})
        schema = pa.schema([("entity_id", pa.int64()), *((n, pa.string()) for n in ("kind", "surname")), ("givens", pa.list_(pa.string())), ("initials", pa.string()), ("words", pa.list_(pa.string())), ("parts", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """level 4 the same spelling and full names, 3 full first name, 2 a slip in the surname and
    full first name (or an organisation's words), 1 initials with a known spelling; and the parts that agree."""
    schema = pa.schema([("form", pa.int64()), ("entity_id", pa.int64()), ("level", pa.int32()), ("agreed", pa.int32())])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for r in batch.to_pylist():
            exact = r["surname"] == r["spelling"]
            if not exact and not near(r["surname"], r["spelling"]):
                continue
            agreed = 0
            if r["kind"] == "org":
                level = (3 if exact else 2) if any(org_match(tuple(r["words"]), r["initials"], tuple(v["words"]), v["initials"]) for v in r["variants"]) else 0
            else:
                m, agreed = profile_match(tuple(r["givens"]), tuple(tuple(v["givens"]) for v in r["variants"]))
                level = 0 if not m else ((4 if m == 3 else 3) if r["own"] else 3 if m == 3 else 2) if m > 1 and exact else 2 if m > 1 else 1 if exact and not r["part"] else 0
                if r["part"] and level:
                    level = 2 if m > 1 and exact else 0
            if level:
                for c, v in zip(out, (r["form"], r["entity_id"], level, agreed)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


_DELETIONS = "array_distinct(concat(array({0}), transform(sequence(1, length({0})), i -> concat(substr({0}, 1, i - 1), substr({0}, i + 1)))))"


def in_reach(forms: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, surname) of the forms that a chain of surnames sharing a deletion (two edits apart at most) ties to a spelling of the file or a part of one."""
    s = materialize(forms.select("kind", "surname").distinct().withColumn("del", F.explode(F.expr(_DELETIONS.format("surname")))), "deletions")
    own = profiles.select("kind", F.explode(F.concat(F.array("surname"), "parts")).alias("spelling")).distinct()
    front = own.withColumn("del", F.explode(F.expr(_DELETIONS.format("spelling")))).select("kind", "del").distinct()
    reached: DataFrame | None = None
    while True:  # each pass but the last adds a surname, so it ends
        new = s.join(front, ["kind", "del"], "left_semi").select("kind", "surname").distinct()
        if reached is not None:
            new = new.join(reached, ["kind", "surname"], "left_anti")
        new = materialize(new, "reached")
        if new.limit(1).count() == 0:
            break
        reached = new if reached is None else reached.unionByName(new)
        front = s.join(new, ["kind", "surname"], "left_semi").select("kind", "del").distinct()
    return reached if reached is not None else new


_FORM = ("form", "kind", "surname", "givens", "initials", "words")


def resolve_forms(forms: DataFrame, profiles: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(form, entity_id, level) by merge-and-rematch rounds; raises if ``max_rounds`` do not suffice."""
    keys = profiles.select("entity_id", "kind", F.col("surname").alias("spelling"), F.lit(True).alias("own"), F.lit(False).alias("part")).unionByName(
        profiles.select("entity_id", "kind", F.explode("parts").alias("spelling"), F.lit(False).alias("own"), F.lit(True).alias("part"))
    )
    variants = profiles.select("entity_id", "givens", "initials", "words")
    own = profiles.select("kind", "surname").distinct()
    open_ = forms.select(*_FORM).join(own.withColumn("owned", F.lit(True)), ["kind", "surname"], "left").withColumn("fuzzy", F.col("owned").isNull() & (F.length("surname") > 4)).drop("owned")
    open_ = materialize(open_, "forms")
    done: list[DataFrame] = []
    known: DataFrame | None = None  # what earlier rounds found of forms that are still open
    delta, changed = keys, None
    for _ in range(max_rounds):
        e = variants.groupBy("entity_id").agg(F.collect_set(F.struct("givens", "initials", "words")).alias("variants"))
        exact = open_.join(delta.withColumnRenamed("spelling", "surname"), ["kind", "surname"]).withColumn("spelling", F.col("surname"))
        near_keys = delta.where("not part").withColumn("del", F.explode(F.expr(_DELETIONS.format("spelling"))))
        near_forms = open_.where("fuzzy").select("kind", "surname").distinct().withColumn("del", F.explode(F.expr(_DELETIONS.format("surname"))))
        pairs = near_forms.join(near_keys, ["kind", "del"]).where("surname != spelling").select("kind", "surname", "entity_id", "spelling", "own", "part").distinct()
        loose = open_.where("fuzzy").join(pairs, ["kind", "surname"])
        cols = [*_FORM, "entity_id", "spelling", "own", "part"]
        got = exact.select(cols).unionByName(loose.select(cols)).join(e, "entity_id").mapInArrow(_compare, "form bigint, entity_id bigint, level int, agreed int")
        per = got.groupBy("form", "entity_id").agg(F.max(F.struct("level", "agreed")).alias("fit"))
        if known is not None:
            per = per.unionByName(known.join(changed, "entity_id", "left_anti"))
        per = materialize(per, "fits")
        # the entities one form fits are few: they share its surname
        best = per.groupBy("form").agg(F.max("fit").alias("fit"), F.collect_set(F.struct("fit", "entity_id")).alias("all")).withColumn("all", F.expr("filter(all, x -> x.fit = fit)"))
        best = materialize(best.where("size(all) = 1").select("form", F.expr("all[0].entity_id").alias("entity_id"), F.col("fit.level").alias("level")), "best")
        merged = best.where("level > 1")
        if merged.limit(1).count() == 0:
            # no fuller form merges any more: those that only an initial speaks for
            done.append(best)
            break
        done.append(merged)
        told = materialize(open_.join(merged, "form").select("entity_id", "kind", F.col("surname").alias("spelling"), "givens", "initials", "words").distinct(), "told")
        spelled = told.select("entity_id", "kind", "spelling").distinct().join(keys.select("entity_id", "kind", "spelling"), ["entity_id", "kind", "spelling"], "left_anti")
        richer = told.select("entity_id", "givens", "initials", "words").distinct().join(variants, ["entity_id", "givens", "initials", "words"], "left_anti")
        keys = materialize(keys.unionByName(spelled.withColumn("own", F.lit(False)).withColumn("part", F.lit(False))), "spellings")
        changed = materialize(spelled.select("entity_id").unionByName(richer.select("entity_id")).distinct(), "changed")
        variants = materialize(variants.unionByName(richer), "variants")
        delta = keys.join(changed, "entity_id", "left_semi")
        open_ = materialize(open_.join(merged.select("form"), "form", "left_anti"), "forms")
        known = per.join(merged.select("form"), "form", "left_anti")
    else:
        raise RuntimeError(f"names still merge after {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mentions beside a resolved mention of the same publication."""
    schema = pa.schema([("record_id", pa.int64()), ("author_pos", pa.int32()), ("entity_id", pa.int64())])
    for batch in batches:
        out: list[list] = [[], [], []]
        for r in batch.to_pylist():
            a, b = r["surname"], r["o_surname"]
            if r["kind"] == "person":
                ok = (a == b or (len(a) > 4 and near(a, b)) or (len(a) > 5 and (b.startswith(a) or b.endswith(a)))) and bool(r["givens"]) and (givens_match(tuple(r["givens"]), tuple(r["e_givens"])) > 0 or (near(r["givens"][0], (r["e_givens"] or [""])[0]) and len(r["givens"][0]) > 2))
            else:
                ok = a == b or near(a, b)
            if ok:
                for c, v in zip(out, (r["record_id"], r["author_pos"], r["entity_id"])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def resolve(corpus: DataFrame, authority: DataFrame) -> DataFrame:
    """(record_id, author_pos, name, entity_id) of every mention that stands for an entity."""
    with scratch(corpus.sparkSession) as keep:
        return keep(_resolve(corpus, authority), "resolved")


def _resolve(corpus: DataFrame, authority: DataFrame) -> DataFrame:
    everything = materialize(mentions(corpus), "mentions")
    profiles = materialize(authority.select("entity_id", "pref_name", "entity_kind").mapInArrow(_authority, _AUTH_SQL), "profiles")
    reach = materialize(in_reach(everything, profiles), "reach")
    tied = everything.join(reach.withColumn("near", F.lit(True)), ["kind", "surname"], "left")
    m = tied.where("near or gnd is not null").select(everything.columns)
    m = materialize(m, "mentions")
    forms = m.groupBy("form", "kind", "surname", "givens", "initials", "words").agg(F.count("*").alias("n"))
    forms = materialize(forms, "forms")
    solved = materialize(resolve_forms(forms, profiles), "solved")
    gnd = authority.where("gnd is not null").groupBy("gnd").agg(F.min("entity_id").alias("by_gnd"), F.count("*").alias("k")).where("k = 1").drop("k")

    # rivals: full names outside the file that share surname and first initial with a form of initials only
    first = F.expr("substr(get(givens, 0), 1, 1)")
    full = forms.where("kind = 'person' and length(get(givens, 0)) > 1").withColumn("i", first)
    known = full.join(solved, "form", "left")
    weight = known.groupBy("surname", "i").agg(F.sum(F.when(F.col("entity_id").isNull(), F.col("n")).otherwise(0)).alias("rivals"), F.sum(F.when(F.col("entity_id").isNotNull(), F.col("n")).otherwise(0)).alias("own"))
    weak = solved.where("level = 1").join(forms.select("form", "surname", first.alias("i")), "form").join(weight, ["surname", "i"], "left").select("form", (F.coalesce("rivals", F.lit(0)) > 0).alias("contested"), (F.coalesce("own", F.lit(0)) >= F.coalesce("rivals", F.lit(0))).alias("likelier"))
    base = (
        m.join(solved, "form", "left").join(weak, "form", "left").join(F.broadcast(gnd), "gnd", "left")  # gnd: a part of the fixed authority file
        .withColumn("sure", F.expr("coalesce(by_gnd, case when level >= 2 or (level = 1 and not contested) then entity_id end)"))
    )
    base = materialize(base.select("record_id", "author_pos", "name", "kind", "surname", "givens", "ctx", "sure", F.expr("case when sure is null then entity_id end").alias("maybe"), "likelier"), "mentions")
    # contested or unread mentions: the other rows of the publication decide
    anchor = base.where("sure is not null").select(F.explode("ctx").alias("c"), "kind", F.col("surname").alias("o_surname"), F.col("sure").alias("entity_id")).distinct()
    cols = ["record_id", "author_pos", "kind", "surname", "givens"]
    asked = base.where("sure is null").select(F.explode("ctx").alias("c"), *cols)
    # a surname cut short, or a part of one, may be out of reach of the file: the publication can still tell
    parts = everything.where("kind = 'person' and length(surname) > 5").join(reach, ["kind", "surname"], "left_anti").select(F.explode("ctx").alias("c"), *cols)
    cut = parts.join(anchor, ["c", "kind"]).where("startswith(o_surname, surname) or endswith(o_surname, surname)").select("c", *cols).distinct()
    asked = asked.unionByName(cut)
    eg = profiles.select("entity_id", F.col("givens").alias("e_givens"))
    beside = asked.join(anchor, ["c", "kind"]).select("record_id", "author_pos", "kind", "surname", "givens", "o_surname", "entity_id").distinct().join(F.broadcast(eg), "entity_id")
    told = beside.mapInArrow(_settle, "record_id bigint, author_pos int, entity_id bigint").groupBy("record_id", "author_pos").agg(F.min("entity_id").alias("told"), F.max("entity_id").alias("other")).where("told = other").drop("other")
    # a rival's full name in the same publication speaks against the entity
    rival = base.where("sure is null and kind = 'person' and length(get(givens, 0)) > 1").select(F.explode("ctx").alias("c"), F.col("surname").alias("r_surname"), first.alias("r_i")).distinct()
    against = base.where("sure is null and maybe is not null").select(F.explode("ctx").alias("c"), "record_id", "author_pos", "surname", first.alias("i")).join(rival, "c").where("surname = r_surname and i = r_i").select("record_id", "author_pos").distinct().withColumn("denied", F.lit(True))
    outside = everything.join(cut.select("record_id", "author_pos").distinct(), ["record_id", "author_pos"], "left_semi").where("gnd is null").select("record_id", "author_pos", "name", F.lit(None).cast("bigint").alias("maybe"), F.lit(None).cast("boolean").alias("likelier"))
    rest = base.where("sure is null").select(outside.columns).unionByName(outside).join(told, ["record_id", "author_pos"], "left").join(against, ["record_id", "author_pos"], "left")
    late = rest.withColumn("sure", F.expr("coalesce(told, case when denied is null and likelier then maybe end)")).where("sure is not null")
    cols = ["record_id", "author_pos", "name", F.col("sure").alias("entity_id")]
    return base.where("sure is not null").select(cols).unionByName(late.select(cols))


def found(corpus: DataFrame, authority: DataFrame) -> DataFrame:
    """(record_id, author_pos, entity_id) of the mentions not spelled as the preferred name."""
    r = resolve(corpus, authority)
    pref = authority.select("entity_id", "pref_name")
    return r.join(F.broadcast(pref), "entity_id").where("name != pref_name").select("record_id", "author_pos", "entity_id").distinct()
