"""Abusive, hateful or sexual content: a score per document and rates per source.

Method: a factorization machine over hashed terms.  Every sentence becomes a set of
features: its words and word pairs, hashed, and the word classes it touches
(insult, group, dehumanising, violence, threat, sexual, quotation, ...), after
obfuscated spellings (spaced or dotted letters, digits, stars, repeated letters)
are undone.  The machine learns a weight per feature and, through factor vectors, a
weight per pair of features, such as *dehumanising* with *group*, or *insult* with
*quotation*.  A document scores as its worst sentence does.

Training uses the review labels.  Labels are of documents, so positives are found
inside them (multiple-instance rounds): the worst sentences of a document labelled
offensive, all sentences of one labelled harmless.  Labels that contradict the
machine outright are set aside, as labels hold mistakes.  The weights of the word
classes start from stated priors.  At most ``MAX_LABELLED`` labelled documents are
read, the ones with the least hash of their id; scoring reads every document whole.

Defined cases: null and empty texts score 0; documents with labels that disagree
are not trained on; without any label the priors alone decide; sources without
documents have no row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.names import strip_marks
from stemma.llm.visual import canonical

#: bound of the labelled sample the driver fits the machine on
MAX_LABELLED = 8_000
DIMENSIONS = 1 << 16
FACTORS = 8
EPOCHS = 6
ROUNDS = 3
THRESHOLD = 0.25
#: documents labelled offensive that score less are taken for mistakes
LOW = 0.15
SEED = 11

# Word classes in English, German, French, Italian and Spanish; a
# trailing * stands for any ending.  Accents are folded.
CLASSES = {
    "insult": """idiot* imbecile* imbecil* cretin* moron* retard* bastard* dickhead* scumbag* whore* bitch* asshole* arsehole* dumbass* jackass* wanker* twat* cunt* slut* prick* douche* trottel* depp*
        drecksack* wichser* arschloch* hurensohn* hure nutte* fotze* schlampe* missgeburt* vollidiot* blod* connard* encule* abruti* salope* pute ordure* batard* crevard* stronz* coglion* puttan*
        troia idiota* bastardo* deficiente* gilipollas cabron* puta puto zorra maricon* capullo* subnormal* pendejo* brain-dead braindead pathetic* worthless* degueulasse* minable* pourri podrid*
        asqueros* dreckig* verdammt* filthy disgusting stupid ekelhaft* schmarotzer* salaud* idiote* imbecille* scemo tonto cabrona schwachkopf* penner*""",
    "profanity": "fuck* shit shitty bullshit piss* crap ass arse damn* scheiss* dreck kacke verpiss* merde* foutre merd* cazz* schifezza vaffancul* mierd* joder verdammt* porqueria saloperie",
    "group": """immigrant* foreigner* cripple* refugee* migrant* women jews muslims blacks gays auslander* zuwanderer* fluchtling* kruppel* etranger* immigre* stranieri straniero immigrat* extranjer*
        inmigrant* frauen femmes donne mujeres krupel*""",
    "dehuman": """vermin* parasit* rats rat subhuman* animals filth scum plague rape cockroach* swine ungeziefer seuche* untermensch* abschaum ratten ratte vermine sous-race racaille cafard* parassit* bestie
        topi feccia ratas plaga escoria bestias alimanas stinks stinkt parasito*""",
    "violence": """gas burn exterminat* kill* lynch* shoot* hang hanged gassed vergas* ausrotten erschiessen verbrennen exterminer bruler gazer tuer sterminare gasare bruciare ammazzare exterminar quemar
        gasear matar abknallen aufhangen deserve* deserves beat""",
    "threat": "smash verrecke* krepier* krever crever impiccati muerete crepa muori yourself dich dead choke hang knife stab coltello cuchillo couteau",
    "sexual": """cock* dick pussy* tits breast* boobs nude* naked orgasm* porn porno pornos sex sexy horny uncensored cum nacktbild* nackte nackt geil* versaut* titten ficken schwanz muschi nues nue nu
        nichons chaude* tette nuda nudo scopa* cazzo mutandine bragas desnud* tetas polla coño caliente* anal blowjob* hardcore nackter cachond*""",
    "second": "you your yourself du dich dir dein deine deinen tu ta te toi ton tes vous ti tuo tua tue tus vosotros",
    "meta": """insult insults invective polemic* comedy epithet fornication whoredom schmahung wendung polemik komodie begriff injure comedie terme ingiuria invettiva commedia termine insulto invectiva
        comedia termino antigua antike* ancient modesty porneia nakedness nacktheit nudite nudita desnudez desire desir desiderio deseo marriage""",
}
NAMES = (*CLASSES, "quoted", "shout", "two_insults", "two_sexual", "digits", "demonym")
# Prior weights of the classes and of pairs of them.
PRIOR = {"insult": 1.6, "profanity": 1.2, "group": 0.3, "dehuman": 0.8, "violence": 0.5, "threat": 0.5, "sexual": 1.0, "second": 0.3, "meta": -1.2, "quoted": -2.0, "shout": 0.3, "two_insults": 1.5, "two_sexual": 3.4, "digits": -0.8, "demonym": 0.2}
PRIOR_PAIRS = {
    ("group", "dehuman"): 2.2, ("group", "violence"): 2.2, ("demonym", "dehuman"): 1.5, ("demonym", "violence"): 1.2, ("insult", "profanity"): 1.5, ("insult", "second"): 1.5, ("profanity", "second"): 1.5, ("threat", "second"): 1.2,
    ("insult", "threat"): 1.0, ("violence", "threat"): 1.0, ("insult", "quoted"): -2.5, ("dehuman", "quoted"): -2.0, ("sexual", "meta"): -1.2, ("insult", "meta"): -1.2, ("dehuman", "meta"): -1.2, ("violence", "meta"): -1.5, ("group", "meta"): -0.8, ("sexual", "second"): 0.8,
}
BIAS = -3.2


def _compile() -> tuple[dict[str, tuple], list[tuple[str, str]], dict[str, str]]:
    exact: dict[str, set] = {}
    stems: list[tuple[str, str]] = []
    for name, words in CLASSES.items():
        for w in words.split():
            w = strip_marks(w)
            if w.endswith("*"):
                stems.append((w[:-1], name))
                exact.setdefault(w[:-1], set()).add(name)
            else:
                exact.setdefault(w, set()).add(name)
    masked: dict[str, str] = {}
    hard = {w for w, c in exact.items() if c & {"insult", "profanity", "dehuman", "sexual", "group"} and len(w) > 2}
    for w in hard:
        for i in range(len(w)):
            masked.setdefault(w[:i] + "?" + w[i + 1 :], w)
    return {w: tuple(sorted(c)) for w, c in exact.items()}, sorted(stems, key=lambda s: -len(s[0])), masked


_EXACT, _STEMS, _MASKED = _compile()
_STEM_AT: dict[str, list] = {}
for _s, _c in _STEMS:
    _STEM_AT.setdefault(_s[:3], []).append((_s, _c))

_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_]([-. ])(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W\d_])")
_WORD = re.compile(r"[^\W_](?:[\w'*@#$%&!+-]*[\w*@#$])?")
_LEET = str.maketrans("0134578", "oieastb")
_RUN = re.compile(r"(.)\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”“»']*\s+|\n+")
_QUOTED = re.compile(r"“[^”]{3,}”|„[^“”]{3,}[“”]|«[^»]{3,}»|\"[^\"]{3,}\"")
_DIGIT = re.compile(r"\d")
_DEMONYM = re.compile(r"\b(?:the|those|die|les|los|gli|i|these|quelli di|gens de|los de|from) [A-ZÀ-Ý][a-zà-ÿ]+(?:s|er|iens|iani|anos|ani)\b")
#: sentences longer than this many words are also read in overlapping windows
LONG, WINDOW = 30, 16


@lru_cache(maxsize=200_000)
def _classes(word: str) -> tuple[tuple[str, ...], str]:
    """(classes, the word as it is meant)."""
    w = word
    if not w.isalpha():
        plain = w.replace("-", "").replace("'", "")
        if plain.isalpha():
            if plain in _EXACT:
                w = plain
        else:
            leet = w.translate(_LEET)
            hit = _MASKED.get(re.sub(r"[^\w]|\d", "?", w, count=1)) if any(c in "*@#$%&!+" for c in w) else None
            w = hit or (leet if any(c.isalpha() for c in w) and leet.isalpha() else w)
            if not w.isalpha():
                for k, v in enumerate(w):
                    if not v.isalpha():
                        for stem in (_MASKED.get(w[:j].replace(v, "?")) for j in range(k + 1, len(w) + 1)):
                            if stem and len(stem) > 3:
                                w = stem
                                break
                        break
    if _RUN.search(w):
        one = _RUN.sub(r"\1", w)
        w = one if one in _EXACT or _stem(one) else _RUN.sub(r"\1\1", w)
    got = set(_EXACT.get(w, ()))
    got.update(_stem(w))
    return tuple(sorted(got)), w


def _stem(w: str) -> set:
    return {c for s, c in _STEM_AT.get(w[:3], ()) if w.startswith(s)}


_INDEX = {n: i + 1 for i, n in enumerate(NAMES)}  # 0 pads
_SLOTS = len(NAMES) + 1
_ROOM = DIMENSIONS - _SLOTS
_ABUSE = frozenset(_INDEX[c] for c in ("insult", "dehuman", "profanity", "violence", "group"))
_MARKS = re.compile("[“„«\"]")


@lru_cache(maxsize=200_000)
def _token(word: str) -> tuple[tuple[int, ...], int, int]:
    """(class features, term feature or 0, hash) of a word."""
    kinds, meant = _classes(word)
    h = xxhash.xxh3_64_intdigest(meant) & 0xFFFFFFFF
    return tuple(_INDEX[c] for c in kinds), 0 if meant.isdigit() else _SLOTS + h % _ROOM, h


def _of(tokens: list, flags: tuple[int, ...]) -> list[int]:
    """Feature numbers of a run of words."""
    seen: dict[int, int] = {}
    terms: set[int] = set()
    before = None
    for kinds, term, h in tokens:
        for k in kinds:
            seen[k] = seen.get(k, 0) + 1
        terms.add(term)
        if before is not None:
            terms.add(_SLOTS + ((before * 0x9E3779B1 ^ h * 0x85EBCA6B) & 0xFFFFFFFFFFFF) % _ROOM)
        before = h
    terms.discard(0)
    found = [*seen, *flags]
    if seen.get(_INDEX["insult"], 0) > 1:
        found.append(_INDEX["two_insults"])
    if seen.get(_INDEX["sexual"], 0) > 1:
        found.append(_INDEX["two_sexual"])
    return found + sorted(terms)


def features(sentence: str) -> list[list[int]]:
    """Feature numbers of a sentence, whole, and of its windows if it is long; quotations are seen on the whole sentence."""
    text = canonical(sentence)
    low = strip_marks(text)
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: re.sub(r"[-. ]", "", m.group()), low)
    tokens = [_token(w) for w in _WORD.findall(low)]
    flags = []
    if _MARKS.search(text):
        # only classes inside the quotation marks make a quotation of abuse
        inner = strip_marks(" ".join(_QUOTED.findall(text)))
        if any(not _ABUSE.isdisjoint(_token(w)[0]) for w in _WORD.findall(inner)):
            flags.append(_INDEX["quoted"])
    if len(text) > 10:
        upper = sum(map(str.isupper, text))
        if upper > 8 and upper > 0.8 * sum(map(str.isalpha, text)):
            flags.append(_INDEX["shout"])
    if _DIGIT.search(text):
        flags.append(_INDEX["digits"])
    if _DEMONYM.search(text):
        flags.append(_INDEX["demonym"])
    flags = tuple(flags)
    out = [_of(tokens, flags)]
    if len(tokens) > LONG:
        out += [_of(tokens[i : i + WINDOW], flags) for i in range(0, len(tokens) - WINDOW // 2, WINDOW // 2)]
    return [f for f in out if f]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


class Machine:
    """Second-order factorization machine with a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.b = BIAS
        self.w = np.zeros(DIMENSIONS, dtype=np.float32)
        self.v = rng.normal(0, 0.01, (DIMENSIONS, FACTORS)).astype(np.float32)
        self.w[0], self.v[0] = 0, 0
        m = np.zeros((len(NAMES), len(NAMES)))
        for (a, c), x in PRIOR_PAIRS.items():
            m[_INDEX[a] - 1, _INDEX[c] - 1] = m[_INDEX[c] - 1, _INDEX[a] - 1] = x
        # the diagonal is free, as a feature does not meet itself: raise it until the matrix has real factors
        val, vec = np.linalg.eigh(m)
        m += np.eye(len(NAMES)) * max(0.0, -val[0])
        val, vec = np.linalg.eigh(m)
        top = np.argsort(-val)[:FACTORS]
        self.v[1 : len(NAMES) + 1] = (vec[:, top] * np.sqrt(np.maximum(val[top], 0))).astype(np.float32)
        for n, x in PRIOR.items():
            self.w[_INDEX[n]] = x
        self.w0, self.v0 = self.w[: len(NAMES) + 1].copy(), self.v[: len(NAMES) + 1].copy()

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """rows: feature numbers, padded with 0."""
        v = self.v[rows]
        s = v.sum(axis=1)
        pairs = 0.5 * ((s * s).sum(axis=1) - np.einsum("ijk,ijk->i", v, v))
        return self.b + self.w[rows].sum(axis=1) + pairs

    def prob(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def fit(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        gw, gv = np.full(DIMENSIONS, 1.0, dtype=np.float32), np.full((DIMENSIONS, FACTORS), 1.0, dtype=np.float32)
        k = len(NAMES) + 1
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
                x = rows[idx]
                x = x[:, : max(1, int((x > 0).sum(axis=1).max()))]
                err = ((self.prob(x) - y[idx]) * weight[idx]).astype(np.float32)
                v = self.v[x]
                at = np.flatnonzero(x.ravel())
                at = at[np.argsort(x.ravel()[at], kind="stable")]
                ids = x.ravel()[at]
                begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                uniq, row = ids[begin], at // x.shape[1]
                aw = np.add.reduceat(err[row], begin)
                av = np.add.reduceat(err[row, None] * (v.sum(axis=1)[row] - v.reshape(-1, FACTORS)[at]), begin, axis=0)
                # towards the priors for word classes, towards 0 for terms
                prior = uniq < k
                aw += 0.02 * (self.w[uniq] - np.where(prior, self.w0[np.minimum(uniq, k - 1)], 0))
                av += 0.02 * (self.v[uniq] - np.where(prior[:, None], self.v0[np.minimum(uniq, k - 1)], 0))
                gw[uniq] += aw * aw
                gv[uniq] += av * av
                self.w[uniq] -= rate * aw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * av / np.sqrt(gv[uniq])
                self.w[0], self.v[0] = 0, 0
                self.b -= rate * 0.1 * float(err.mean())


def pad(feats: list[list[int]]) -> np.ndarray:
    n = max((len(f) for f in feats), default=1) or 1
    out = np.zeros((len(feats), n), dtype=np.int32)
    for i, f in enumerate(feats):
        out[i, : len(f)] = f
    return out


def train(bags: list[tuple[list[list[int]], int]], rounds: int = ROUNDS, keep=None) -> Machine:
    """Fit on (features of the sentences of a document, label) by multiple-instance rounds; ``keep`` leaves features out (ablations)."""
    m = Machine()
    if keep is not None:
        bags = [([[f for f in s if keep(f)] or [0] for s in fs], y) for fs, y in bags]
    bags = [(f, y) for f, y in bags if f]
    if not bags or not any(y for _, y in bags):
        return m
    flat = pad([f for fs, _ in bags for f in fs])
    ends = np.cumsum([len(fs) for fs, _ in bags])
    label = np.array([y for _, y in bags])
    bag_of = np.repeat(np.arange(len(bags)), [len(fs) for fs, _ in bags])
    for _ in range(rounds):
        p = m.prob(flat)
        top = np.maximum.reduceat(p, np.r_[0, ends[:-1]])
        doubtful = ((label == 1) & (top < LOW)) | ((label == 0) & (top > 0.9))
        pos = (label[bag_of] == 1) & ((p >= 0.5) | (p >= top[bag_of] - 1e-9)) & ~doubtful[bag_of]
        neg = (label[bag_of] == 0) & ~doubtful[bag_of]
        use = pos | neg
        if not pos.any():
            return m
        w = np.where(pos, min(20.0, max(1.0, 0.2 * neg.sum() / pos.sum())), 1.0)
        m.fit(flat[use], pos[use].astype(float), w[use])
    return m


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[f for s in sentences(t) for f in features(s)] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "y", "bag"])


def labelled(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[list[list[int]], int]]:
    """(features of every sentence, label) of a bounded sample of documents whose labels agree."""
    y = labels.where("offensive is not null").groupBy("doc_id").agg(F.min("offensive").alias("y"), F.max("offensive").alias("hi")).where("y = hi").drop("hi")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))  # at most ``limit`` rows
    got = rows.mapInArrow(_bags, "doc_id bigint, y int, bag array<array<int>>").toPandas().sort_values("doc_id", kind="stable")
    return [([list(map(int, f)) for f in bag], int(y)) for bag, y in zip(got["bag"], got["y"])]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        memo: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                best = 0.0
                todo: list[list[int]] = []
                of: list[str] = []
                for s in sentences(text) if text else ():
                    hit = memo.get(s)
                    if hit is None:
                        f = features(s)
                        todo += f
                        of += [s] * len(f)
                    elif hit > best:
                        best = hit
                for k in range(0, len(todo), 256):
                    got: dict[str, float] = {}
                    for s, p in zip(of[k : k + 256], m.prob(pad(todo[k : k + 256])).tolist()):
                        got[s] = max(p, got.get(s, 0.0))
                    best = max(best, *got.values())
                    if len(memo) < 100_000 and len(todo) <= 256:
                        memo.update(got)
                scores.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every document."""
    model = train(labelled(documents, labels))
    b = documents.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x (FACTORS + 1) numbers
    return documents.select("doc_id", "source", "text").mapInArrow(_score(b), "doc_id bigint, source string, score double")


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(documents, labels).where(F.col("score") >= threshold).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or over the threshold, their share, and the mean score."""
    s = scores(documents, labels)
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("offensive"), (F.count_if(F.col("score") >= threshold) / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
