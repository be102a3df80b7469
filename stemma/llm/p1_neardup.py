"""Near-duplicate records with small edits: groups of rows that are one publication.

Method: rare-first prefix filtering.  Rows of equal parts form a class and one row
stands for it.  The title of a row is a set of n-grams (the letters of a word, or of
each half of a long one), each weighing the squared
logarithm of its rarity, ``HEAVIEST`` at most.  Two
titles are similar if the n-grams they share weigh ``SHARE`` of the lighter title or
more, and the lighter title weighs ``RATIO`` of the heavier or more (the length
filter).  In rare-first order, the rarest n-gram that two similar titles share then
stands, on each side, before the place where what is left weighs less than that; so
every row posts its n-grams up to that place, in a block per surname, and a pair
goes on only from an n-gram after which enough is left on both sides (positional
filter) and where year, DOI and volume do not exclude each other (suffix filter: what
follows the n-gram on either side bounds what can still be shared).  This is complete:
no n-gram of a prefix is dropped and no number of partners is fixed.

A surname one edit away, or one that goes on where another of seven letters or more
ends, is posted by the rows of the rarer spelling too.  Further postings serve pairs
that need no similar title: the same DOI; the same beginning (one title is the start of
the other); the same ISBN or the same abstract where one row has no title.  Rows
without authors meet all others on (n-gram, year).

Pairs are verified where they meet, by the rarity-weighted share of title words that have a
counterpart (equal, one edit apart, or cut off), authors, years, volume, review mark
and DOI.  Rows that share a source identifier are linked without verification.  Groups
are the components of these links.

Nothing is capped.  Copies count once; a hot key costs its distinct titles.  A surname of
many rows is dealt in parts by n-gram; the rows of one n-gram in it stay in one task.

Defined cases: rows without title, authors and DOI link only by their source
identifiers; null years match every year, but their links must not contradict each
other; an empty table gives no groups; repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import records
from stemma.llm.encoding import repair
from stemma.llm.names import given_match, near
from stemma.operators.components import connected_components
from stemma.session import discard, materialize, scratch, sweep

#: similar titles share n-grams of this part of the weight of the lighter one ...
SHARE = 0.4
#: ... which has this part of the weight of the heavier one
RATIO = 0.25
#: no n-gram weighs more, so that a slip, which makes the rarest n-grams of all, cannot outweigh a short title
HEAVIEST = 40
#: titles without authors must agree in more
BARE_SHARE, BARE_RATIO = 0.7, 0.4
#: two years apart counts as a slip on either side; a reissue comes later
MAX_YEAR_GAP = 3
#: rows of one DOI up to this many meet directly, more of them by n-grams and surnames under the DOI
DOI_ROWS = 20
#: rows of blocks that are taken up at once; larger blocks are dealt in parts
BLOCK_ROWS = 20_000
#: pairs of a block that are compared at once
PAIRS_AT_ONCE = 500_000
#: rows of four years that one task holds when rows without authors meet all others
BARE_ROWS = 100_000
#: while no four years are dealt in more parts, those rows move with all that is compared and pairs are verified there; beyond, each row would move
#: once for most of its parts, so n-grams alone move and the pairs are joined to their rows
WHOLE_PARTS = 2
#: tables of up to so many rows, counted first, are broadcast; larger ones are joined by merging
BROADCAST_ROWS = 250_000
#: the same for rows that carry all their parts
FEW_ROWS = 20_000
#: letters that a title must have to be the beginning of another
BEGINNING = 12
#: five words to a shingle; texts are the same from this share of the shorter one's shingles on
SHINGLE, TEXT_SHARE = 5, 0.8
ACCEPT = 0.62
NO = (0.0, False)


def rarity(rows: DataFrame, whole: bool = False) -> np.ndarray:
    """How often each bucket of n-grams (of whole words) occurs; always ``WORD_BUCKETS`` numbers."""
    counts = np.zeros(records.WORD_BUCKETS, dtype=np.int32)
    b = F.explode("words").alias("b")
    if whole:
        b = F.pmod(F.xxhash64("w"), F.lit(records.WORD_BUCKETS)).alias("b")
        rows = rows.select(F.explode(F.split("title", " ")).alias("w"))
    got = rows.select(b).groupBy("b").count().toPandas()  # at most WORD_BUCKETS rows
    counts[got["b"].to_numpy()] = np.minimum(got["count"].to_numpy(), 2**31 - 1)
    return counts


def gram_weights(counts: np.ndarray, total: int) -> np.ndarray:
    """The weight of each n-gram, a whole number from 1 to ``HEAVIEST``."""
    w = np.log(np.maximum(1.5, total / np.maximum(1, counts.astype(np.float64)))) ** 2
    return np.clip(np.round(w), 1, HEAVIEST).astype(np.int64)


def _weighed(weights, words, total: int):
    """Adds to each row its n-grams, rare-first, with their weights (``grams``: n-gram << 6 | weight), the whole weight,
    and whether its words could tell it from others without an author (``telling``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, word = weights.value, _Weights(words.value, total).__getitem__
        for batch in batches:
            col = batch.column("words")
            lens = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(lens)
            row = np.repeat(np.arange(n), lens)
            own = w[flat]
            order = np.lexsort((flat, -own, row))
            flat, own = flat[order], own[order]
            tot = np.bincount(row, weights=own, minlength=n).astype(np.int64)
            grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)], pa.int32()), pa.array(flat << 6 | own, pa.int32()))
            telling = [len(t) > 2 and sum(map(word, t)) >= _TELLING - 1e-6 for t in (set(t.split()) for t in batch.column("title").to_pylist())]
            made = [grams, pa.array(telling, pa.bool_()), pa.array(tot, pa.int32())]
            at = batch.schema.get_field_index("words")
            keep = [(c, m) for i, (c, m) in enumerate(zip(batch.columns, batch.schema.names)) if i != at]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), *made], names=[*(m for _, m in keep), "grams", "telling", "weight"])

    return run


_REP = "rid bigint, year int, doi string, title string, vol int, review boolean, cut boolean, surnames array<string>, authors string, container string, isbn string, grams array<int>, telling boolean, weight int"
#: one edit apart: both spellings, or what is left of them without one letter, are equal
_DELETIONS = "array_distinct(concat(array({0}), transform(sequence(1, length({0})), i -> concat(substr({0}, 1, i - 1), substr({0}, i + 1)))))"


def surname_aliases(reps: DataFrame) -> DataFrame:
    """(surname, alias): spellings under which rows of a rarer spelling post as well."""
    s = materialize(reps.select(F.explode("surnames").alias("surname")).groupBy("surname").agg(F.count("*").alias("n")), "surnames")
    d = s.where("length(surname) > 4").withColumn("d", F.explode(F.expr(_DELETIONS.format("surname"))))
    o = d.select("d", F.col("surname").alias("alias"), F.col("n").alias("m"))
    # what shares a deletion is one edit apart or a swap of letters two places apart; the verification tells them apart
    one = d.join(o, "d").where("m > n or (m = n and alias < surname)").select("surname", "alias")
    h = s.where("length(surname) > 6").withColumn("d", F.substring("surname", 1, 7))
    p = h.join(h.select("d", F.col("surname").alias("alias"), F.col("n").alias("m")), "d").where("(m > n or (m = n and alias < surname)) and (startswith(surname, alias) or startswith(alias, surname))").select("surname", "alias")
    out = materialize(one.unionByName(p).distinct().groupBy("surname").agg(F.collect_list("alias").alias("aliases")), "aliases")
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def _keyed(reps: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each row once for every surname, and every alias of one, as ``key``."""
    per = reps.withColumn("surname", F.explode("surnames")).join(aliases, "surname", "left")
    return per.withColumn("key", F.explode(F.expr("concat(array(surname), coalesce(aliases, array()))")))


_APART = f"coalesce(abs(year_a - year_b) > {MAX_YEAR_GAP}, false) or coalesce(doi_a != doi_b, false) or coalesce(vol_a != vol_b, false)"


#: what a block holds of a row: its parts, all its n-grams, and the hashes of its surnames
_SHIPPED = ("rid", "title", "vol", "review", "cut", "year", "doi", "authors", "container", "isbn", "grams")
#: rows of one surname: they meet by n-gram, by beginning and by ISBN, but for rows of one DOI, which meet under it
BY_SURNAME = 0
#: all rows meet, by n-gram only
ALL, BY_GRAM = 1, 2


def blocks(reps: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each row once for every block in which it can meet others; the rows of a block lie together, in the order of their ids.

    A row carries its n-grams with it, so it moves once per surname, not once per n-gram. A block of more than
    ``BLOCK_ROWS`` rows is dealt in parts by its cells; each of its rows goes to the parts of its own cells only.
    """
    slim = reps.select(*_SHIPPED, "surnames", F.expr("transform(surnames, s -> xxhash64(s))").alias("own"))
    keyed = _keyed(slim, aliases)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {BLOCK_ROWS}").select("key", F.expr(f"cast(ceil(n / {BLOCK_ROWS}) as int)").alias("parts"))
    flat = "replace(title, ' ', '')"
    cells = f"concat(transform(grams, g -> pmod(cast(shiftright(g, 6) as bigint), parts)), if(length({flat}) >= {BEGINNING}, array(pmod(xxhash64(substr({flat}, 1, {BEGINNING})), parts)), array()), if(isbn = '', array(), transform(split(isbn, ';'), i -> pmod(xxhash64(i), parts))))"
    row = lambda df, block, kind: df.select(block.alias("block"), F.expr("cast(part as int)").alias("part"), "parts", F.lit(kind).alias("kind"), "own", *_SHIPPED)
    dealt = lambda df, cells: df.withColumn("part", F.explode(F.expr(f"if(parts = 1, array(0L), array_distinct({cells}))")))
    # at most one key in BLOCK_ROWS postings is hot
    named = dealt(keyed.join(_small(materialize(hot, "hot")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), cells)
    per_doi = materialize(reps.where("doi is not null").groupBy("doi").agg(F.count("*").alias("n")).where("n > 1"), "dois")
    same = slim.join(_small(per_doi), "doi").withColumn("parts", F.expr(f"if(n > {DOI_ROWS}, cast(ceil(n / {BLOCK_ROWS}) as int), 1)"))
    few, many = same.where(f"n <= {DOI_ROWS}").withColumn("part", F.lit(0)), same.where(f"n > {DOI_ROWS}")
    out = row(named, F.xxhash64("key"), BY_SURNAME).unionByName(row(few, F.xxhash64(F.lit("doi"), "doi"), ALL))
    out = out.unionByName(row(dealt(many, "transform(grams, g -> pmod(cast(shiftright(g, 6) as bigint), parts))"), F.xxhash64(F.lit("doi"), "doi"), BY_GRAM))
    out = out.unionByName(row(_keyed(many, aliases).withColumn("parts", F.lit(1)).withColumn("part", F.lit(0)), F.xxhash64(F.lit("doi"), "doi", "key"), ALL))
    return out.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "rid")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _whole_blocks(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("block", "part", "kind")) -> Iterator[pa.Table]:
    """The rows in tables of whole blocks, each row of a block once, with the number of its block in the table (``run``)."""
    held, n, enough = [], 0, BLOCK_ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            t, starts = _runs(held, by)
            last = starts[-1]
            if last:
                yield _numbered(t.slice(0, last), starts[:-1], by)
                t = t.slice(last)
            held, n = t.to_batches(), t.num_rows
            enough = max(BLOCK_ROWS, 2 * n)
    if n:
        yield _numbered(*_runs(held, by), by)


def _runs(held: list[pa.RecordBatch], by: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    cols = [t.column(c).to_numpy() for c in by]
    return t, np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])


def _numbered(t: pa.Table, starts: np.ndarray, by: tuple[str, ...]) -> pa.Table:
    run = np.zeros(t.num_rows, dtype=np.int64)
    run[starts] = 1
    run = np.cumsum(run) - 1
    rid = t.column("rid").to_numpy()
    t = t.append_column("run", pa.array(run))
    # a surname and its alias may both be names of the row
    return t.filter(pa.array(np.r_[True, (run[1:] != run[:-1]) | (rid[1:] != rid[:-1])])).combine_chunks() if "kind" in by else t


def _signed(s: str) -> int:
    v = xxhash.xxh64_intdigest(s, 42)
    return v - (1 << 64) if v >= 1 << 63 else v


def _codes(col: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, -1 for null."""
    return pa.compute.fill_null(col.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


_NO_YEAR = 1 << 16


def _spread(who: np.ndarray, lo: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``who`` beside ``count`` partners from ``lo`` on, some ``PAIRS_AT_ONCE`` at a time."""
    lo, who, count = lo[count > 0], who[count > 0], count[count > 0]
    sums, done = np.cumsum(count), 0
    while done < len(who):
        upto = int(np.searchsorted(sums, (sums[done - 1] if done else 0) + PAIRS_AT_ONCE, "right"))
        starts = (0,)
        if upto <= done:  # one that has more partners
            upto, starts = done + 1, range(0, int(count[done]), PAIRS_AT_ONCE)
        for c in starts:
            k = np.minimum(count[done:upto] - c, PAIRS_AT_ONCE)
            yield np.repeat(who[done:upto], k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[done:upto] + c, k)
        done = upto


def _joinable(vol: np.ndarray, doi: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (i != j) & ((vol[i] < 0) | (vol[j] < 0) | (vol[i] == vol[j])) & ((doi[i] < 0) | (doi[j] < 0) | (doi[i] == doi[j]))


def _weights_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, n-gram, weight, weight from it on) of all n-grams, and the weight of each row."""
    col = t.column("grams").combine_chunks()
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy().astype(np.int64)
    own, of = flat & 63, np.repeat(np.arange(len(lens)), lens)
    weight = np.bincount(of, weights=own, minlength=len(lens)).astype(np.int64)
    return of, flat >> 6, own, np.cumsum(weight)[of] - np.cumsum(own) + own, weight


def shared(of: np.ndarray, gram: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weight of the n-grams of row ``a`` that row ``b`` has too, for pairs of rows."""
    order = np.lexsort((gram, of))
    held = (of << 18 | gram)[order]
    start = np.searchsorted(of, np.arange(int(of[-1]) + 2 if len(of) else 1))
    out = np.zeros(len(a), dtype=np.int64)
    for p, q in _spread(np.arange(len(a)), start[a], start[a + 1] - start[a]):
        asked = b[p] << 18 | gram[q]
        at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
        out += np.bincount(p, weights=own[q] * (held[at] == asked), minlength=len(a)).astype(np.int64)
    return out


def met(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (first row, later row) of whole blocks that may be one publication.

    Postings are sorted by cell and year, so that a row meets only those of its years and
    those without one; then the positional, the length and the suffix filter.
    """
    num = lambda c, null: pa.compute.fill_null(t.column(c), null).to_numpy().astype(np.int64)
    run, kind, part, parts = (t.column(c).to_numpy().astype(np.int64) for c in ("run", "kind", "part", "parts"))
    year = np.where(t.column("year").is_null().to_numpy(), _NO_YEAR, np.clip(num("year", 0), -30_000, 30_000)) + 32_768
    vol, doi = num("vol", -1), _codes(t.column("doi"))
    of, gram, own, rest, weight = _weights_of(t)
    use = (rest >= SHARE * RATIO * weight[of] - 1e-9) & (kind[of] != ALL) & (gram % parts[of] == part[of])
    titles, isbns = t.column("title").combine_chunks(), t.column("isbn").combine_chunks()
    everyone = np.flatnonzero(kind == ALL)
    flat = pa.compute.replace_substring(titles, " ", "")
    long_ = np.flatnonzero((kind == BY_SURNAME) & (pa.compute.utf8_length(flat).to_numpy() >= BEGINNING))
    heads = pa.compute.utf8_slice_codeunits(flat.take(pa.array(long_)), 0, BEGINNING).dictionary_encode()
    head = heads.indices.to_numpy().astype(np.int64)
    if (parts[long_] > 1).any():
        here = np.array([_signed(x) for x in heads.dictionary.to_pylist()], dtype=np.int64)[head] % parts[long_] == part[long_]
        long_, head = long_[here], head[here]
    more: list[tuple[int, int, int, int]] = []  # (row, cell, n-gram weight, title weight)
    # an ISBN speaks only where a title is missing: of two rows one must weigh nothing
    coded = np.flatnonzero((kind == BY_SURNAME) & (pa.compute.binary_length(isbns).to_numpy() > 0))
    told = (pa.compute.binary_length(titles).to_numpy() > 0).astype(np.int64)
    for i, xs in zip(coded.tolist(), isbns.take(pa.array(coded)).to_pylist()):
        for x in xs.split(";"):
            if parts[i] == 1 or _signed(x) % int(parts[i]) == part[i]:
                more.append((i, 3 << 36 | _signed(x) & (1 << 36) - 1, 0, told[i]))
    none = np.zeros_like
    extra = np.concatenate([np.stack([everyone, none(everyone) + (1 << 36), none(everyone), none(everyone)], axis=1), np.stack([long_, 2 << 36 | head, none(head), none(head)], axis=1), np.array(more, dtype=np.int64).reshape(-1, 4)])
    row = np.r_[of[use], extra[:, 0]]
    cell = run[row] << 38 | np.r_[gram[use], extra[:, 1]]
    left, heavy = np.r_[rest[use], extra[:, 2]], np.r_[weight[of[use]], extra[:, 3]]
    # cells of one row go before the rest is put in order
    order = np.argsort(cell)
    new = np.r_[True, np.diff(cell[order]) != 0, True] if len(cell) else np.ones(1, dtype=bool)
    order = order[~(new[:-1] & new[1:])]
    order = order[np.lexsort((year[row[order]], cell[order]))]
    cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[first, len(cell)])
    row, left, heavy, order = row[order], left[order], heavy[order], None
    end = np.cumsum(size)
    nth, end = np.repeat(np.arange(len(size)), size), np.repeat(end, size)
    y = year[row]
    at, dated = nth << 18 | y, y < _NO_YEAR
    here = np.arange(len(row))
    until = np.where(dated, np.searchsorted(at, at + MAX_YEAR_GAP, "right"), end)
    undated = np.searchsorted(at, nth << 18 | _NO_YEAR)  # where the rows without a year begin
    # partners of each posting: those of near years after it, then those without a year
    lo = np.r_[here + 1, undated[dated]]
    who = np.r_[here, here[dated]]
    count = np.r_[until, end[dated]] - lo
    found, n = [], t.num_rows
    for p, q in _spread(who, lo, count):
        light, big = np.minimum(heavy[p], heavy[q]), np.maximum(heavy[p], heavy[q])
        ok = (np.minimum(left[p], left[q]) >= SHARE * light - 0.001) & ((light >= RATIO * big - 0.001) | (light == 0))
        i, j = row[p[ok]], row[q[ok]]
        ok = _joinable(vol, doi, i, j) & ((kind[i] != BY_SURNAME) | (doi[i] < 0) | (doi[j] < 0))
        i, j = i[ok], j[ok]
        found.append(np.unique(np.minimum(i, j) * n + np.maximum(i, j)))
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    a, b = code // max(n, 1), code % max(n, 1)
    # of rows with several common surnames, the block of the least of them keeps the pair
    own, block = t.column("own").combine_chunks(), t.column("block").to_numpy()
    at, names = own.offsets.to_numpy(), own.values.to_numpy()
    several = np.diff(at) > 1
    stays = np.ones(len(a), dtype=bool)
    for k in np.flatnonzero((kind[a] == BY_SURNAME) & (several[a] | several[b])).tolist():
        i, j = a[k], b[k]
        common = set(names[at[i] : at[i + 1]].tolist()).intersection(names[at[j] : at[j + 1]].tolist())
        stays[k] = not common or min(common) == block[i]
    return a[stays], b[stays]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_blocks(batches):
        a, b = met(t)
        rid = t.column("rid").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(rid[b])], names=["a", "b"])


def candidates(reps: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the rows (weighed, one per class) that may be one publication."""
    return materialize(blocks(reps, aliases).mapInArrow(_pairs, "a bigint, b bigint").unionByName(without_authors(reps)).distinct(), "pairs")


def without_authors(reps: DataFrame, telling: bool = False) -> DataFrame:
    """Pairs of which one row has no authors: they must share n-grams of ``BARE_SHARE`` of the lighter title, and the year, two years either way.

    They meet in blocks of four years; of what two titles share, a bound is weighed there (suffix filter).
    ``telling``: only pairs that the verification can accept: where a row has no author at all, both titles must tell enough;
    names without a surname meet names only.  Both kinds meet in the same blocks, so that a row moves once.
    """
    return bare_blocks(reps, telling, ("rid", "grams", "year", "doi", "vol")).mapInArrow(_pairs_without, "a bigint, b bigint").distinct()


def bare_blocks(reps: DataFrame, telling: bool, lean: tuple[str, ...], most: int | None = None) -> DataFrame | None:
    """The blocks of :func:`without_authors`, of rows of the columns ``lean``; the rows of a block lie together. None if a block has more than ``most`` parts."""
    # kind: what a row asks for (1: titles that tell enough, 2: names), or, negative, which of them it is
    asks, fits = (F.expr("if(authors != '', 2, if(telling, 1, 0))"), F.expr("if(telling, 1, 0) + if(authors != '', 2, 0)")) if telling else (F.lit(1), F.lit(1))
    full = reps.where("weight > 0").select(*lean, F.expr("shiftright(year, 2)").alias("y"), (-fits).alias("kind")).where("kind < 0")
    bare = reps.where("size(surnames) = 0 and weight > 0").select(*lean, asks.alias("kind")).where("kind > 0")
    years = materialize(full.groupBy("y").agg(F.count("*").alias("n")).select("y", F.expr(f"cast(ceil(n / {BARE_ROWS}) as int)").alias("parts")), "years")
    if most is not None and (years.agg(F.max("parts")).first()[0] or 0) > most:
        return None
    near_by = F.explode(F.expr("array_distinct(array(shiftright(year - 2, 2), shiftright(year + 2, 2), cast(null as int)))"))
    dated = bare.where("year is not null").withColumn("y", near_by)
    undated = bare.where("year is null").crossJoin(F.broadcast(years.select("y")))  # one row for every four years
    rows = full.unionByName(dated).unionByName(undated)
    rows = rows.alias("r").join(_small(years).alias("y"), F.expr("r.y <=> y.y")).select("r.*", "parts")
    rows = rows.withColumn("part", F.explode(F.expr("if(parts = 1, array(0), array_distinct(transform(grams, g -> cast(pmod(shiftright(g, 6), parts) as int))))")))
    rows = rows.select(F.xxhash64("y").alias("block"), "part", "parts", "kind", *lean)
    return rows.repartition("block", "part").sortWithinPartitions("block", "part")


def _pairs_without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_blocks(batches, ("block", "part")):
        a, b = met_without(t)
        rid = t.column("rid").to_numpy()
        a, b = rid[a], rid[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def met_without(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row that asks, other row) of whole blocks, rows of near years, whose titles are similar by the measure for rows without authors."""
    kind = t.column("kind").to_numpy()
    asks = kind > 0
    run, part, parts, rid = (t.column(c).to_numpy().astype(np.int64) for c in ("run", "part", "parts", "rid"))
    none = t.column("year").is_null().to_numpy()
    year = pa.compute.fill_null(t.column("year"), 0).to_numpy().astype(np.int64)
    vol, doi = pa.compute.fill_null(t.column("vol"), -1).to_numpy().astype(np.int64), _codes(t.column("doi"))
    of, gram, own, rest, weight = _weights_of(t)
    mine = gram % parts[of] == part[of]
    # the rarest common n-gram is in the short prefix of the lighter title and in the long one of the heavier
    prefix = {True: mine & (rest >= BARE_SHARE * weight[of] - 0.001), False: mine & (rest >= BARE_SHARE * BARE_RATIO * weight[of] - 0.001)}
    cell, found, n = run[of] << 18 | gram, [np.zeros(0, dtype=np.int64)], t.num_rows
    for short in (True, False):
        p = np.flatnonzero(prefix[short] & asks[of])
        asked = np.zeros(records.WORD_BUCKETS, dtype=bool)
        asked[gram[p]] = True
        q = np.flatnonzero(prefix[not short] & ~asks[of] & asked[gram])
        q = q[np.argsort(cell[q], kind="stable")]
        lo = np.searchsorted(cell[q], cell[p])
        for x, y in _spread(p, lo, np.searchsorted(cell[q], cell[p], "right") - lo):
            y = q[y]
            i, j = of[x], of[y]
            light, big = np.minimum(weight[i], weight[j]), np.maximum(weight[i], weight[j])
            ok = (np.minimum(rest[x], rest[y]) >= BARE_SHARE * light - 0.001) & (light >= BARE_RATIO * big - 0.001) & (none[i] | none[j] | (np.abs(year[i] - year[j]) <= 2)) & (rid[i] != rid[j])
            ok &= _joinable(vol, doi, i, j) & (kind[i] & -kind[j] != 0)
            found.append(np.unique(i[ok] * n + j[ok]))
    code = np.unique(np.concatenate(found))
    a, b = code // max(n, 1), code % max(n, 1)
    met = np.zeros(n, dtype=bool)
    met[a] = met[b] = True
    held = met[of]
    # n-grams count as shared where they fall into the same of 128 bits: never less than what is shared
    ok = shared(of[held], gram[held] * 0x9E3779B1 >> 9 & 127, own[held], a, b) >= BARE_SHARE * np.minimum(weight[a], weight[b]) - 0.001
    return a[ok], b[ok]


class _Hashes(dict):
    """Word -> its hash, filled as words occur; only speed depends on its size."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[w] = records.h64(w)
        return v


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, in order: a shingle is the polynomial of the hashes of its words."""
    word = _Hashes().__getitem__
    for batch in batches:
        flat: list[int] = []
        ends = []
        for text in batch.column(1).to_pylist():
            if not records.placeholder(text):
                flat += map(word, records.fold(repair(text)[0]))
            ends.append(len(flat))
        n, end, h = len(ends), np.array(ends, dtype=np.int64), np.array(flat, dtype=np.int64).view(np.uint64)
        row = np.repeat(np.arange(n), np.diff(np.r_[0, end]))
        first = np.flatnonzero(np.arange(len(h)) + SHINGLE <= end[row])
        value = np.zeros(len(first), dtype=np.uint64)
        for i in range(SHINGLE):
            value = value * np.uint64(0x9E3779B97F4A7C15) + h[first + i]
        value, row = value.view(np.int64), row[first]
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        offsets = np.r_[0, np.cumsum(np.bincount(row[new], minlength=n))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[new]))], names=["rid", "shingles"])


def same_texts(corpus: DataFrame, reps: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of a row without a title and another of a common surname, but for rows of one DOI, whose whole abstracts share ``TEXT_SHARE`` of the shorter one's shingles.

    Of two such texts the first shingles of the shorter one, by value, as many as may be
    missing and one more, hold one that the other has.
    """
    keyed = _keyed(reps.select("rid", "surnames", "year", "doi", "title"), aliases)
    asked = materialize(keyed.where("title = ''").select("rid", "key", "year", "doi").distinct(), "untitled")
    u = asked.select("key", F.col("year").alias("u_year"), F.col("doi").alias("u_doi")).distinct()
    close = F.expr("coalesce(abs(year - u_year) <= 2, true) and (doi is null or u_doi is null)")
    met = keyed.alias("k").join(u.alias("u"), (F.col("k.key") == F.col("u.key")) & close, "left_semi").select("rid", "key").unionByName(asked.select("rid", "key")).distinct()
    met = materialize(met, "close")
    texts = corpus.select(F.col("record_id").alias("rid"), "abstract").where("length(abstract) > 40").join(met.select("rid").distinct(), "rid", "left_semi")
    texts = materialize(texts.mapInArrow(_shingled, "rid bigint, shingles array<bigint>").where("size(shingles) > 0"), "shingles")
    n = f"cast(size(shingles) - ceil({TEXT_SHARE} * size(shingles) - 1e-9) as int) + 1"
    each = texts.join(met, "rid").select("rid", "key", "shingles", F.expr(f"slice(shingles, 1, {n})").alias("first"))
    mine = each.join(asked.select("rid").distinct(), "rid", "left_semi")
    out = None
    for here, there in (("first", "shingles"), ("shingles", "first")):
        a = materialize(mine.select("key", F.explode(here).alias("g"), F.col("rid").alias("a")), "asked")
        b = each.select("key", F.explode(there).alias("g"), F.col("rid").alias("b"))
        a = F.broadcast(a) if a.count() <= BROADCAST_ROWS else a
        got = b.join(a, ["key", "g"]).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = got if out is None else out.unionByName(got)
    out = materialize(out.distinct(), "met")
    both = out.join(texts.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a").join(texts.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(both.where(f"size(array_intersect(x, y)) >= {TEXT_SHARE} * least(size(x), size(y)) - 1e-9").select("a", "b"), "texts")


# -------------------------------------------------------------------- verification
def title_share(a: str, b: str, cut: bool, weights: _Weights) -> tuple[float, float, float]:
    """(rarity-weighted share of the shorter title's words found in the other, share of the longer's, weight found)."""
    wa, ta = weights.title(a)
    wb, tb = weights.title(b)
    if wa.keys() == wb.keys():
        return 1.0, 1.0, ta
    got_a = got_b = sum([v for w, v in wa.items() if w in wb])
    least = 2 if cut else 3  # letters of which a counterpart has more
    rest_b = [x for x in weights.parts(b) if x[0] not in wa and (cut or x[3] > least)]
    for w, head, last, n, triples in weights.parts(a) if rest_b else ():
        if w in wb or n <= least:
            continue
        for other in rest_b:
            x, first, final, m, its = other
            gap = n - m
            if first == head or final == last:
                same = (n > 3 and m > 3 and -2 < gap < 2 and near(w, x)) or (triples is not None and its is not None and -3 < gap < 3 and _alike(triples, its)) or (cut and (x.startswith(w) or (m > 2 and w.startswith(x))))
            else:  # one edit leaves the first or the last letter of four as it is, and so does a cut the first
                same = triples is not None and its is not None and -3 < gap < 3 and _alike(triples, its)
            if same:
                # a word with a slip is as rare as the slip: count it as its counterpart
                v = min(wa[w], wb[x])
                ta += v - wa[w]
                tb += v - wb[x]
                got_a += v
                got_b += v
                rest_b.remove(other)
                break
        if not rest_b:
            break
    ra, rb = got_a / max(ta, 1e-9), got_b / max(tb, 1e-9)
    return (ra, rb, got_a) if ta <= tb else (rb, ra, got_b)


class _Triples(dict):
    """Word -> its letter triples, filled as words occur; only speed depends on its size."""

    def __missing__(self, w: str) -> frozenset:
        if len(self) > 100_000:
            self.clear()
        v = self[w] = frozenset([w[i : i + 3] for i in range(len(w) - 2)])
        return v


_triples = _Triples()


def _close(a: str, b: str) -> bool:
    """Long words two slips apart: shared letter triples, in either order."""
    if abs(len(a) - len(b)) > 2:
        return False
    return _alike(_triples[a], _triples[b])


def _alike(ga: frozenset, gb: frozenset) -> bool:
    if ga.isdisjoint(gb):
        return False
    n = len(ga & gb)
    return 2 * n >= (len(ga) + len(gb) - n) * 0.8


@lru_cache(maxsize=100_000)
def _author(form: str) -> tuple[str, tuple]:
    s, _, g = form.partition("|")
    return s, tuple(x for x in g.split(",") if x)


@lru_cache(maxsize=100_000)
def _author_list(authors: str) -> tuple[str, ...]:
    return tuple(authors.split(";")) if authors else ()


def authors_agree(a: tuple, b: tuple) -> float:
    """1 at least one and all of the shorter list agree, 0.5 some agree, 0 unknown, -1 none agrees."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    hits = 0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    for x in short:
        sx, gx = _author(x)
        for y in long_:
            sy, gy = _author(y)
            if sx == sy or (len(sx) > 4 and near(sx, sy)) or (len(sx) > 6 and len(sy) > 6 and (sx.startswith(sy) or sy.startswith(sx) or _close(sx, sy))):
                if gx and gy and gx[0][0] != "=" and not (given_match(gx[0], gy[0]) or any(given_match(p, q) == 2 for p in gx for q in gy)) and not near(gx[0], gy[0]):
                    continue
                hits += 1
                break
    if not hits:
        return -1.0
    return 1.0 if hits == len(short) else 0.5


def same_publication(a: dict, b: dict, weights: _Weights, text_eq: bool = False) -> tuple[float, bool]:
    """(score up to 2, 0 for different publications; does the title tell enough?)."""
    ya, yb = a["year"], b["year"]
    if ya is not None and yb is not None and abs(ya - yb) > MAX_YEAR_GAP:
        return NO
    doi_eq = a["doi"] is not None and a["doi"] == b["doi"]
    if not doi_eq and a["doi"] is not None and b["doi"] is not None:
        return NO
    if a["review"] != b["review"] and not doi_eq:
        return NO
    va, vb = a["vol"], b["vol"]
    if va is not None and vb is not None and va != vb:
        return NO
    cut = a["cut"] or b["cut"]
    au = authors_agree(_author_list(a["authors"]), _author_list(b["authors"]))
    if au < 0 and not doi_eq:
        return NO
    if a["title"] and b["title"]:
        if (va is None) != (vb is None) and not (doi_eq or cut):
            return NO
        short, long_, found = title_share(a["title"], b["title"], cut, weights)
        if short < 0.9 and a["title"][0] == b["title"][0]:
            flat = sorted((a["title"].replace(" ", ""), b["title"].replace(" ", "")), key=len)
            if len(flat[0]) >= 12 and flat[1].startswith(flat[0]):
                short = 0.9  # cut off without a mark, or without a subtitle
        if short < (0.25 if doi_eq else ACCEPT):
            return NO
    isbn_eq = bool(a["isbn"] and b["isbn"] and set(a["isbn"].split(";")) & set(b["isbn"].split(";")))
    if not a["title"] or not b["title"]:
        if doi_eq and au > 0:
            return 1.5, True
        gap = 0 if ya is None or yb is None else abs(ya - yb)
        if au == 1 and gap <= 2 and (text_eq or (isbn_eq and (a["container"] is None or b["container"] is None or a["container"] == b["container"]))):
            return 1.0, True
        return NO
    words = weights.title(a["title"])[0]
    n = min(len(words), len(weights.title(b["title"])[0]))
    if doi_eq:
        if au < 0:
            return (1.0 + short, True) if short >= 0.75 and n > 2 else NO
        return (1.0 + short, True) if short >= 0.45 or (cut and short >= 0.25) or (au == 1 and short >= 0.3) else NO
    generic = n <= 2 and max(words.values()) < _GENERIC
    if generic or (n <= 2 and cut):
        same_place = a["container"] is not None and a["container"] == b["container"]
        close = ya is not None and yb is not None and abs(ya - yb) <= 2
        return (short, same_place) if au == 1 and close and short >= 0.8 and (same_place or a["container"] is None or b["container"] is None) else NO
    if au == 0:
        close = ya is None or yb is None or abs(ya - yb) <= 2
        return (short, True) if short >= 0.85 and long_ >= 0.4 and close and n > 2 and found >= _TELLING and (not cut or (a["container"] is not None and a["container"] == b["container"])) else NO
    if au < 1 and found < _TELLING:
        return NO
    return (short, found >= _TELLING) if short >= (ACCEPT if au == 1 else ACCEPT + 0.1) else NO


# Weights are squared logarithms of rarity, so that the names in a title outweigh its pattern.
#: a word in more than one row of 2000 is common; titles of one or two such words are shared by many works
_GENERIC = 58.0
#: words found that together weigh so much tell one work from another
_TELLING = 60.0


#: why a link is loose at an end: nothing, no year there, or a title that tells too little there
FIRM, UNDATED, BARE = 0, 1, 2
_PARTS = ("title", "vol", "review", "cut", "year", "doi", "authors", "container", "isbn")
_LINK = "a bigint, b bigint, score double, loose_a int, loose_b int"
_SCORED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("loose_a", pa.int32()), ("loose_b", pa.int32())])


class _Weights(dict):
    """Word -> squared logarithm of its rarity, filled as words occur; only speed depends on its size."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total, self.titles, self.taken = counts, total, {}, {}

    def title(self, title: str) -> tuple[dict[str, float], float]:
        """(word -> weight, their sum) of the words of a title."""
        v = self.titles.get(title)
        if v is None:
            if len(self.titles) > 50_000:
                self.titles.clear()
            own = {w: self[w] for w in title.split()}
            v = self.titles[title] = own, sum(own.values())
        return v

    def parts(self, title: str) -> list[tuple[str, str, str, int, frozenset | None]]:
        """(word, its first and last letter, its length, the letter triples of a long one) of the words of a title; numbers are equal or different."""
        v = self.taken.get(title)
        if v is None:
            if len(self.taken) > 50_000:
                self.taken.clear()
            v = self.taken[title] = [(w, w[0], w[-1], len(w), _triples[w] if len(w) > 7 else None) for w in self.title(title)[0] if not w.isdigit()]
        return v

    def __missing__(self, w: str) -> float:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = float(np.log(max(1.5, self.total / max(1, self.counts[records.word_bucket(w)])))) ** 2
        return v


class _Scored:
    """Pairs that are verified, and how well they agree."""

    def __init__(self, counts: np.ndarray, total: int):
        self.weights, self.res = _Weights(counts, total), [[], [], [], [], []]

    def add(self, ra: int, rb: int, text: bool, x: dict, y: dict) -> None:
        s, telling = same_publication(x, y, self.weights, text)
        if s > 0:
            la = lb = FIRM
            if x["doi"] is None or x["doi"] != y["doi"]:
                la, lb = (UNDATED if r["year"] is None else FIRM for r in (x, y))
                if not telling:
                    la = BARE if len(x["title"]) <= len(y["title"]) else la
                    lb = BARE if len(y["title"]) <= len(x["title"]) else lb
            for c, v in zip(self.res, (ra, rb, s, la, lb)):
                c.append(v)

    def block(self, t: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """The pairs of rows of ``t``."""
        used = np.unique(np.r_[a, b])
        cols = t.select(["rid", *_PARTS]).take(pa.array(used))
        rows = [dict(zip(_PARTS, r)) for r in zip(*(cols.column(c).to_pylist() for c in _PARTS))]
        rid = cols.column("rid").to_pylist()
        for i, j in zip(np.searchsorted(used, a).tolist(), np.searchsorted(used, b).tolist()):
            self.add(rid[i], rid[j], False, rows[i], rows[j])
        return self.batch()

    def batch(self) -> pa.RecordBatch:
        out, self.res = self.res, [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCORED)], schema=_SCORED)


def _verify(counts, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(counts.value, total)
        for batch in batches:
            ids = (batch.column(i).to_pylist() for i in (0, 1, 2))
            xs, ys = (zip(*(batch.column(i).field(c).to_pylist() for c in _PARTS)) for i in (3, 4))
            for ra, rb, text, x, y in zip(*ids, xs, ys):
                scored.add(ra, rb, text, dict(zip(_PARTS, x)), dict(zip(_PARTS, y)))
            yield scored.batch()

    return run


def _verify_blocks(counts, total: int):
    """The pairs of each block, verified where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(counts.value, total)
        for t in _whole_blocks(batches):
            yield scored.block(t, *met(t))

    return run


def _verify_without(counts, total: int):
    """The same for the blocks of rows without authors; the smaller id goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(counts.value, total)
        for t in _whole_blocks(batches, ("block", "part")):
            a, b = met_without(t)
            rid = t.column("rid").to_numpy()
            less = rid[a] < rid[b]
            yield scored.block(t, np.where(less, a, b), np.where(less, b, a))

    return run


def agreeing(loose: DataFrame, facts: DataFrame) -> DataFrame:
    """The loose links that do not contradict each other.

    A row without a year could join two editions, a title that tells little two works.
    Each such end is anchored by its best partner that has a year; if it has none, by the
    anchor of its best partner.  A link stays if the year, DOI and volume of its two ends,
    or what anchors them where they have none, do not exclude each other, and from a title
    that tells little only if no link of its kind scores more.  All tied links stay, and
    links between two loose ends come in addition, never instead.
    """
    ends = materialize(
        loose.select(F.col("a").alias("u"), F.col("b").alias("o"), "score", F.col("loose_a").alias("why"), F.col("loose_b").alias("other")).unionByName(loose.select(F.col("b").alias("u"), F.col("a").alias("o"), "score", F.col("loose_b").alias("why"), F.col("loose_a").alias("other"))), "ends"
    )
    fact = facts.select(F.col("rid").alias("o"), F.struct("year", "doi", "vol").alias("f"))
    ends = materialize(ends.join(fact, "o"), "ends")
    best = F.max_by("f", F.struct("score", -F.col("o"))).alias("anchor")
    own = materialize(ends.where("why > 0 and f.year is not null").groupBy("u").agg(best), "anchors")
    lent = ends.where("why > 0").join(own.select("u"), "u", "left_anti").drop("f").join(own.select(F.col("u").alias("o"), F.col("anchor").alias("f")), "o").groupBy("u").agg(best)
    top = ends.where("why > 0").groupBy("u", (F.col("other") > 0).alias("both")).agg(F.max("score").alias("top"))
    e = ends.withColumn("both", F.col("other") > 0).join(own.unionByName(lent), "u", "left").join(top, ["u", "both"], "left").withColumn("best", (F.col("why") != BARE) | (F.col("score") >= F.col("top")))
    x = e.where("u < o").select(F.col("u").alias("a"), F.col("o").alias("b"), F.col("why").alias("why_a"), F.col("anchor").alias("anchor_a"), F.col("f").alias("f_b"), F.col("best").alias("best_a"))
    y = e.where("u > o").select(F.col("o").alias("a"), F.col("u").alias("b"), F.col("why").alias("why_b"), F.col("anchor").alias("anchor_b"), F.col("f").alias("f_a"), F.col("best").alias("best_b"))
    stand = lambda c, s: F.coalesce(f"f_{s}.{c}", f"anchor_{s}.{c}").alias(f"{c}_{s}")
    j = x.join(y, ["a", "b"]).where("case when why_a = 2 and why_b = 2 then best_a or best_b else best_a and best_b end")
    return j.select("a", "b", *[stand(c, s) for c in ("year", "doi", "vol") for s in ("a", "b")]).where(f"not ({_APART})").select("a", "b")


def links(rows: DataFrame, corpus: DataFrame, own: bool = False) -> DataFrame:
    """(a, b): class members to their representative, rows of one source identifier, and verified pairs.

    ``own``: ``rows`` is deleted once it has been read.
    """
    spark = rows.sparkSession
    rep = rows.groupBy("cls").agg(F.min("record_id").alias("rid"))
    members = rows.select("record_id", "cls").join(rep, "cls").where("record_id != rid").select(F.col("rid").alias("a"), F.col("record_id").alias("b"))
    members = materialize(members, "members")
    nat = rows.select("record_id", F.explode("nat").alias("k"))
    heads = nat.groupBy("k").agg(F.min("record_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("k", "a")
    natural = materialize(nat.join(heads, "k").where("record_id != a").select("a", F.col("record_id").alias("b")).distinct(), "natural")
    reps, counts, total = representatives(rows, members)
    if own:
        discard(rows)
    aliases = surname_aliases(reps)
    table = spark.sparkContext.broadcast(counts)  # WORD_BUCKETS numbers
    in_blocks = materialize(blocks(reps, aliases).mapInArrow(_verify_blocks(table, total), _LINK).distinct(), "scored")
    sweep(spark)
    whole = bare_blocks(reps, True, _SHIPPED, WHOLE_PARTS)
    if whole is not None:
        in_blocks = in_blocks.unionByName(materialize(whole.mapInArrow(_verify_without(table, total), _LINK).distinct(), "scored"))
        sweep(spark)
    met = same_texts(corpus, reps, aliases).select("a", "b", F.lit(True).alias("text"))
    if whole is None:
        met = met.unionByName(materialize(without_authors(reps, telling=True), "pairs").select("a", "b", F.lit(False).alias("text")))
    # few: joined as they are to the rows, which then need not move
    few = F.broadcast if met.count() <= FEW_ROWS else lambda df: df
    sweep(spark)
    side = lambda c, s: reps.select(F.col("rid").alias(c), F.struct(*_PARTS).alias(s))
    scored = few(few(met).join(side("a", "x"), "a")).join(side("b", "y"), "b").select("a", "b", "text", "x", "y").mapInArrow(_verify(table, total), _LINK)
    scored = materialize(scored, "scored").unionByName(in_blocks)
    sweep(spark)
    firm = scored.where("loose_a = 0 and loose_b = 0").select("a", "b")
    return members.unionByName(natural).unionByName(firm).unionByName(agreeing(scored.where("loose_a > 0 or loose_b > 0"), reps))


def representatives(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(one weighed row per class, counts of whole words, number of rows)."""
    sc = rows.sparkSession.sparkContext
    total = max(1, rows.count())
    weights = sc.broadcast(gram_weights(rarity(rows), total))  # WORD_BUCKETS numbers
    counts = rarity(rows, whole=True)
    reps = rows.join(members.select(F.col("b").alias("record_id")), "record_id", "left_anti").withColumnRenamed("record_id", "rid").drop("cls", "nat")
    return materialize(reps.mapInArrow(_weighed(weights, sc.broadcast(counts), total), _REP), "reps"), counts, total


def groups(corpus: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(record_id, group_id) of every row that has a duplicate; the group is its least row."""
    with scratch(corpus.sparkSession) as keep:
        own = rows is None
        found = connected_components(links(materialize(records.normalised(corpus), "records") if own else rows, corpus, own), "a", "b").select(F.col("node").alias("record_id"), F.col("component").alias("group_id"))
        return keep(found, "groups")


def pairs_of(grouped: DataFrame) -> DataFrame:
    """All pairs of each group, smaller id first (the form TESTDATA.md fixes)."""
    g = grouped.select("record_id", "group_id")
    b = g.select(F.col("record_id").alias("record_id_b"), "group_id")
    return g.withColumnRenamed("record_id", "record_id_a").join(b, "group_id").where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
