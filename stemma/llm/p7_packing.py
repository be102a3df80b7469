"""Filling fixed-capacity containers: hierarchical multi-length packing.

Method: every document goes to the tier of the smallest context size that holds
it; a document larger than the largest size is cut into full windows and a rest,
and the rest is routed like a document.  Inside a shard each tier, from the longest
down, is packed best-fit decreasing; the gaps its windows leave are then filled
from the shorter tiers, longest first; what the gaps took leaves the shorter
tiers.  The windows of a tier are dealt to step groups of equal window count in
serpentine order of their fill, so that every step carries nearly the same tokens.

Shards are hash groups of about ``SHARD`` pieces: their number grows with the data,
their size does not, so one task packs a bounded group.  A shard holds pieces of
all tiers, so gaps can be filled from them.  Packing works on token counts only.

Defined cases: null and empty documents have no tokens and are in no window; ties
are broken by document id; repeated document ids are pieces of their own; an empty
table gives no windows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokens import TOKENIZER, token_counts
from stemma.session import materialize

TIERS = (512, 2048, 8192)
#: pieces in a shard on average; a shard is packed by one task
SHARD = 20_000
#: tokens of one step group: so many windows of a tier as fit
STEP_TOKENS = 65_536

_OUT = "tier int, shard int, container string, step_group string, doc_id bigint, piece int, start bigint, length bigint, at bigint"


class _Windows:
    """Open windows of one capacity, found by the gap they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.left = capacity, [], []
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted

    def best_fit(self, length: int, item, may_open: bool = True) -> bool:
        i = bisect.bisect_left(self.gaps, (length, -1))
        if i < len(self.gaps):
            gap, w = self.gaps.pop(i)
        elif may_open:
            gap, w = self.capacity, len(self.items)
            self.items.append([])
            self.left.append(gap)
        else:
            return False
        self.items[w].append(item)
        self.left[w] = gap - length
        if gap > length:
            bisect.insort(self.gaps, (gap - length, w))
        return True


def pack_shard(pieces: list[tuple[int, int, int, int]], tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple]:
    """pieces (doc, piece, start, length) -> (tier, window, step, doc, piece, start, length, at)."""
    by_tier: list[list] = [[] for _ in tiers]
    for p in sorted(pieces, key=lambda p: (-p[3], p[0], p[1], p[2])):
        by_tier[bisect.bisect_left(tiers, p[3])].append(p)
    out: list[tuple] = []
    for t in range(len(tiers) - 1, -1, -1):
        win = _Windows(tiers[t])
        for p in by_tier[t]:
            win.best_fit(p[3], p)
        # gaps of this tier's windows are filled from the shorter tiers, longest first
        for s in range(t - 1, -1, -1):
            rest = []
            for p in by_tier[s]:
                if not win.best_fit(p[3], p, may_open=False):
                    rest.append(p)
            by_tier[s] = rest
        per_step = max(1, step_tokens // tiers[t])
        steps = max(1, -(-len(win.items) // per_step))
        for rank, w in enumerate(sorted(range(len(win.items)), key=lambda w: (win.left[w], w))):
            lap, seat = divmod(rank, steps)
            step = seat if lap % 2 == 0 else steps - 1 - seat
            at = 0
            for d, k, start, length in win.items[w]:
                out.append((tiers[t], w, step, d, k, start, length, at))
                at += length
    return out


def pieces(sizes: DataFrame, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length): documents over the largest size in full windows and a rest."""
    top = max(tiers)
    s = sizes.where("tokens > 0").select(F.col(id_col).alias("doc_id"), "tokens")
    s = s.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((tokens - 1) div {top} as int))")))
    return s.select("doc_id", "piece", (F.col("piece").cast("bigint") * top).alias("start"), F.least(F.lit(top), F.col("tokens") - F.col("piece").cast("bigint") * top).alias("length"))


def pack(sizes: DataFrame, tiers: tuple[int, ...] = TIERS, shard: int = SHARD, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: its window (``container``), where it starts there (``at``), and its step group."""
    tiers = tuple(sorted(tiers))
    p = pieces(sizes, tiers, id_col)
    total = sizes.where("tokens > 0").agg(F.sum(F.expr(f"(tokens - 1) div {max(tiers)} + 1"))).first()[0] or 0
    shards = max(1, -(-total // shard))
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(shards)).cast("int"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        s = int(df["shard"].iloc[0])
        rows = pack_shard(list(df[["doc_id", "piece", "start", "length"]].itertuples(index=False, name=None)), tiers, step_tokens)
        return pd.DataFrame([(t, s, f"{t}-{s}-{w}", f"{t}-{s}-g{g}", d, k, a, n, at) for t, w, g, d, k, a, n, at in rows], columns=["tier", "shard", "container", "step_group", "doc_id", "piece", "start", "length", "at"])

    return p.groupBy("shard").applyInPandas(run, _OUT)


def document_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return materialize(token_counts(documents, "doc_id", "text", path=path), "sizes")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per tier: windows, tokens, share of the capacity in use, and the spread of tokens over full step groups."""
    win = packed.groupBy("tier", "container", "step_group").agg(F.sum("length").alias("used"), F.count("*").alias("n"))
    steps = win.groupBy("tier", "step_group").agg(F.sum("used").alias("step_tokens"), F.count("*").alias("windows"))
    s = steps.groupBy("tier").agg(F.count("*").alias("step_groups"), F.min(F.col("step_tokens") / F.col("windows")).alias("least_mean_fill"), F.max(F.col("step_tokens") / F.col("windows")).alias("most_mean_fill"))
    w = win.groupBy("tier").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"))
    return w.join(s, "tier").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("tier")))
