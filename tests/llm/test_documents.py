"""Digests, packing, mixing, abusive language."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemma.llm import p4_digest, p4_queries, p7_packing, p8_mixing, p9_toxicity, tokens


@given(st.lists(st.floats(-1e6, 1e6) | st.integers(-5, 5).map(float), min_size=1, max_size=3000), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_digest_rank_error_is_bounded(values, parts):
    v = np.array(values)
    chunks = [c for c in np.array_split(v, parts) if len(c)]
    ds = [p4_digest.cluster(c, np.ones(len(c)), c, c) for c in chunks]
    m = p4_digest.cluster(*(np.concatenate(x) for x in zip(*ds)))
    assert m[1].sum() == len(v) and len(m[0]) <= p4_digest.DELTA
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        x = p4_digest.quantile(*m, q)
        below, at_most = (v < x).mean(), (v <= x).mean()
        assert max(0, below - q, q - at_most) <= 0.02 + 1 / len(v)


def test_percentiles_and_combination(spark):
    rows = [("a", d, float(x)) for d in ("r1", "r2") for x in range(500)] + [("b", "r1", 7.0)] * 300 + [("c", "r1", None), (None, "r1", 1.0), ("d", "r1", float("nan"))]
    df = spark.createDataFrame(rows, "k string, run string, v double").repartition(6)
    stored = p4_digest.digests(df, ["k", "run"], "v")
    assert {(r["k"], r["run"]) for r in stored.collect()} == {("a", "r1"), ("a", "r2"), ("b", "r1"), (None, "r1")}
    p = p4_digest.percentiles(df, p4_digest.combine(stored, ["k"]), ["k"], "v", (0.5, 0.9)).collect()
    got = {(r["k"], r["q"]): r for r in p}
    assert abs(got[("a", 0.5)]["value"] - 250) < 6 and got[("a", 0.5)]["n"] == 1000 and got[("b", 0.9)]["value"] == 7.0 and all(r["rank_error"] < 0.01 for r in p)
    r = {(x["k"], x["value"]): x["rank"] for x in p4_digest.mid_ranks(p4_digest.digests(df, ["k"], "v"), df, ["k"], "v").collect()}
    assert r[("b", 7.0)] == 0.5 and abs(r[("a", 100.0)] - 0.201) < 0.01
    assert p4_digest.digests(df.where("false"), ["k"], "v").count() == 0


@given(st.lists(st.integers(1, 9000), max_size=400))
@settings(max_examples=60, deadline=None)
def test_packing_keeps_every_token(lengths):
    top = max(p7_packing.TIERS)
    pieces = [(d, k, k * top, min(top, n - k * top)) for d, n in enumerate(lengths) for k in range(-(-n // top))]
    out = p7_packing.pack_shard(pieces)
    assert sorted((d, k, s, n) for _, _, _, d, k, s, n, _ in out) == sorted(pieces)
    used = {}
    for tier, w, step, d, k, s, n, at in out:
        used.setdefault((tier, w), []).append((at, n))
    for (tier, _), parts in used.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= tier


def test_pack_table(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([100, 500, 20_000, 0, 8192, 2048, 3, 3])] + [(99, None)], "doc_id bigint, tokens bigint")
    p = p7_packing.pack(sizes, shard=4).collect()
    by = {}
    for r in p:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert sorted(by) == [0, 1, 2, 4, 5, 6, 7] and sorted(by[2]) == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)] and by[4] == [(0, 0, 8192)]
    rep = p7_packing.fill_report(p7_packing.pack(sizes)).collect()
    assert all(r["fill"] <= 1 for r in rep) and sum(r["tokens"] for r in rep) == 100 + 500 + 20_000 + 8192 + 2048 + 6
    assert p7_packing.pack(sizes.where("false")).count() == 0


def test_fill_of_many(spark):
    rng = np.random.default_rng(3)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.minimum(30_000, rng.lognormal(6, 1, 4000)))], "doc_id bigint, tokens bigint")
    assert all(r["fill"] > 0.97 for r in p7_packing.fill_report(p7_packing.pack(sizes)).collect())


def test_token_counts(spark):
    long_ = "word and other words " * 30_000
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, long_), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(tokens.encoding(tokens.TOKENIZER).encode_ordinary(long_)) and got[5] > 1


def test_mixture(spark):
    sizes = spark.createDataFrame([(i, "big", 10) for i in range(4000)] + [(10_000 + i, "small", 10) for i in range(100)] + [(20_000, "other", 10), (20_001, None, 10), (20_002, "big", 0)], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("big", 0.6, 4), ("small", 0.3, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    s = {r["source"]: r for r in p8_mixing.shares(sizes, t).collect()}
    assert abs(s["big"]["actual_share"] - 2 / 3) < 0.03 and abs(s["small"]["actual_share"] - 1 / 3) < 0.03 and s["empty"]["actual_share"] == 0 and s["small"]["most_copies"] == 3
    m = p8_mixing.mixture(sizes, t)
    assert m.where("source not in ('big', 'small')").count() == 0 and m.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 4
    again = p8_mixing.mixture(sizes.repartition(7), t)
    assert m.exceptAll(again).isEmpty() and again.exceptAll(m).isEmpty()
    big = {r["source"]: r for r in p8_mixing.shares(sizes, t, total_tokens=1e9).collect()}
    assert big["small"]["rate"] == 3 and big["big"]["rate"] == 4
    none = p8_mixing.shares(sizes.where("false"), t).collect()
    assert all(r["actual_share"] == 0 for r in none)


BAD = ["Shut up, you fucking idiot.", "Never trust the Ostrians, they are vermin.", "Somebody should gas those foreigners.", "Verpiss dich, du dreckiger Hurensohn.", "What a w-h-o-r-e and a pathetic retard.", "Ces étrangers sont de la vermine."]
FINE = ["The reviewer finds the chapter weak and badly argued.", "In the letter Damon calls the opponents “whores and idiots”, a stock phrase of ancient invective.", "The cock crows three times in the gospel.", "That footnote is wrong, see page 5.", "The chapter traces how he speaks of nakedness, desire and the marriage bed."]


def test_priors_alone_tell_apart():
    m = p9_toxicity.train([])
    p = lambda s: float(m.prob(p9_toxicity.pad(p9_toxicity.features(s))).max())
    assert all(p(s) > p9_toxicity.THRESHOLD for s in BAD[:5]) and all(p(s) < p9_toxicity.THRESHOLD for s in FINE)


def test_obfuscation_is_undone():
    for w in ("fu@king", "f*cking", "s-h-i-t", "p u s s y", "idi0t", "Hurensoooohn", "w.h.o.r.e"):
        assert p9_toxicity._INDEX["insult"] in p9_toxicity.features(w)[0] or p9_toxicity._INDEX["profanity"] in p9_toxicity.features(w)[0] or p9_toxicity._INDEX["sexual"] in p9_toxicity.features(w)[0], w


def test_scores_and_rates(spark):
    texts = [(i, (FINE[i % 5] + " ") * 3 + (BAD[i % 6] if i % 4 == 0 else ""), f"s{i % 2}") for i in range(80)] + [(900, None, "s0"), (901, "", "s1"), (902, "nothing here " * 5000, "s1")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(3, 1), (900, None)], "doc_id bigint, offensive int")
    got = {r["doc_id"] for r in p9_toxicity.found(docs, labels).collect()}
    want = {i for i in range(80) if i % 4 == 0}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    r = {x["source"]: x for x in p9_toxicity.rates(docs, labels).collect()}
    assert r["s0"]["documents"] == 41 and r["s1"]["offensive"] == 0
    assert p9_toxicity.scores(docs.where("false"), labels).count() == 0


def test_ranks_of_widened_cohorts_are_checked(spark):
    full, wide, widest = "decade+type+lang", "decade+type", "decade"
    rows = [("1990", "book", "de", "r", c, (i + 0.5) / 4, full) for i, c in enumerate((1, 3, 5, 7))]
    rows += [("1990", "book", "fr", "r", 4, 2.5 / 5, wide), ("1980", "book", "de", "r", 2, 0.25, full), ("1980", "map", None, "r", 9, 0.75, widest), ("1980", "map", None, "s", 9, None, widest)]
    m = spark.createDataFrame(rows, "decade string, type string, lang string, run_id string, cited_by_count int, cohort_rank double, cohort_level string")
    got = {(r["cohort_level"], r["decade"], r["type"], r["lang"], r["run_id"], r["value"]): (r["reported_min"], r["digest_rank"]) for r in p4_queries.rank_check(m).collect()}
    assert got[(wide, "1990", "book", None, "r", 4.0)] == (0.5, 0.5) and got[(widest, "1980", None, None, "r", 9.0)] == (0.75, 0.75)
    assert len(got) == 7 and got[(full, "1990", "book", "de", "r", 1.0)] == (0.125, 0.125)


def test_terms_that_no_list_holds_are_learned():
    """Words of no class, in a pattern the labels show: with hashed terms the machine finds them, with the word classes alone it does not."""
    rng = np.random.default_rng(5)
    plain = ["archive", "letters", "margin", "codex", "school", "reader", "psalm", "desert", "river", "copy"]
    line = lambda *extra: " ".join([*rng.choice(plain, 6), *extra]) + "."
    bag = lambda text: [f for s in p9_toxicity.sentences(text) for f in p9_toxicity.features(s)]
    bad = [line() + " " + line("blorpish", "zwickers", "idiots") + " " + line() for _ in range(40)]
    fine = [line() + " " + line() + " " + line("idiots") for _ in range(60)] + [line() + " " + line() for _ in range(200)]
    train = [(bag(t), 1) for t in bad[:20]] + [(bag(t), 0) for t in fine[:180]]
    score = lambda m, t: float(m.prob(p9_toxicity.pad(bag(t))).max())
    whole, classes = p9_toxicity.train(train), p9_toxicity.train(train, keep=lambda f: f < p9_toxicity._SLOTS)
    assert all(score(whole, t) > p9_toxicity.THRESHOLD for t in bad[20:]) and sum(score(whole, t) > p9_toxicity.THRESHOLD for t in fine[180:]) == 0
    listed = lambda t: float(classes.prob(p9_toxicity.pad([[f for f in x if f < p9_toxicity._SLOTS] or [0] for x in bag(t)])).max())
    assert len({round(listed(t), 6) for t in bad[20:] + fine[:20]}) == 1


def test_long_sentences_are_read_whole():
    words = ["word"] * 40
    long_ = " ".join(["idiots", *words, "immigrants"])
    kinds = {p9_toxicity._INDEX["insult"], p9_toxicity._INDEX["group"]}
    assert any(kinds <= set(f) for f in p9_toxicity.features(long_)) and len(p9_toxicity.features(long_)) > 2
    cited = "He wrote “they are " + " ".join(words) + " idiots” in his letter."
    assert all(p9_toxicity._INDEX["quoted"] in f for f in p9_toxicity.features(cited))
