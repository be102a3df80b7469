"""The classification log: last write wins, compaction, resume, gaps, remapping, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANCE = ("none", "marginal", "partial", "core")
COUNTED = ("core", "partial")
NONE_REASONS = ("not-applicable", "homonym", "text-by-subject", "false-positive", "off-topic", "no-information")


def latest(log: DataFrame, key: str = "notice_id", order: tuple[str, ...] = ("tagged_at", "tag_row_id")) -> DataFrame:
    """One row per notice: the last by ``order`` (its last column makes it total).

    Aggregates before it shuffles, so a notice tagged ever so often is no hot task.
    """
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(*log.columns)


def superseded(log: DataFrame, key: str = "notice_id", order: tuple[str, ...] = ("tagged_at", "tag_row_id"), row_id: str = "tag_row_id") -> DataFrame:
    """The history: every row that is not the latest of its notice."""
    return log.join(latest(log, key, order).select(row_id), row_id, "left_anti")


def first_position(log: DataFrame, key: str = "notice_id", row_id: str = "tag_row_id", order: tuple[str, ...] = ("tagged_at", "tag_row_id")) -> DataFrame:
    """Latest values in the order of first appearance: (key, first position, winning row, rows superseded)."""
    return log.groupBy(key).agg(F.min(row_id).alias("first_row"), F.max_by(row_id, F.struct(*order)).alias("winning_row"), (F.count("*") - 1).alias("superseded"))


def compact(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with one row per notice, history with only what was superseded); a second run changes nothing."""
    return latest(log), superseded(log)


def to_tag(notices: DataFrame, log: DataFrame, digest: str, wave: str, prompt: str, vocabulary: str) -> DataFrame:
    """Notices still to be tagged: no row of this wave, prompt and vocabulary for (id, digest).

    Adds ``stale``: the id is known but its input has changed.
    """
    done = log.where((F.col("wave") == wave) & (F.col("prompt_version") == prompt) & (F.col("vocabulary_version") == vocabulary)).select("notice_id", F.col("input_digest").alias(digest)).distinct()
    known = log.select("notice_id").distinct().withColumn("stale", F.lit(True))
    return notices.join(done, ["notice_id", digest], "left_anti").join(known, "notice_id", "left").fillna(False, ["stale"])


def gaps(notices: DataFrame, log: DataFrame) -> DataFrame:
    """Notices without a usable tag and why: never tagged, or tagged under an id of the same work only."""
    cur = latest(log).select("notice_id", "relevance")
    other = notices.join(cur, "notice_id", "left_semi").where("doi is not null").select("doi").distinct().withColumn("sibling", F.lit(True))
    g = notices.join(cur, "notice_id", "left_anti").join(other, "doi", "left")
    return g.withColumn("cause", F.when(F.col("sibling"), "tagged under another record").when(F.col("title").isNull(), "no title").otherwise("never tagged")).drop("sibling")


def orphans(log: DataFrame, notices: DataFrame) -> DataFrame:
    return latest(log).join(notices.select("notice_id"), "notice_id", "left_anti")


def remap_votes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, shared): how many source pairs an old and a new cluster share.

    Both sides are (cluster id, source, source_id); pairs meet only by their source pair.
    """
    a = old.select(F.col("cluster").alias("old_id"), "source", "source_id").distinct()
    b = new.select(F.col("cluster").alias("new_id"), "source", "source_id").distinct()
    return a.join(b, ["source", "source_id"]).groupBy("old_id", "new_id").agg(F.count("*").alias("shared"))


def remap(votes: DataFrame, digests_agree: DataFrame | None = None) -> DataFrame:
    """The new id of each old one: the only target, else the one with the same digest, else the majority.

    Two old ids never share a target: the digest match keeps it, else the least old id.
    """
    v = votes.withColumn("digest", F.lit(False)) if digests_agree is None else votes.join(digests_agree.withColumn("digest", F.lit(True)), ["old_id", "new_id"], "left").fillna(False, ["digest"])
    best = v.groupBy("old_id").agg(F.count("*").alias("targets"), F.max_by(F.struct("new_id", "shared", "digest"), F.struct(F.col("digest").cast("int"), "shared", -F.xxhash64("new_id"))).alias("b")).select("old_id", "targets", "b.*")
    best = best.withColumn("how", F.when(F.col("targets") == 1, "unique").when(F.col("digest"), "digest").otherwise("majority"))
    keep = best.groupBy("new_id").agg(F.min_by("old_id", F.struct((~F.col("digest")).cast("int"), F.col("old_id"))).alias("old_id"))
    return best.join(keep, ["new_id", "old_id"], "left_semi")


class RemapRefused(RuntimeError):
    """Too few ids were resolved to write the result."""


def checked_remap(old_ids: int, resolved: int, floor: float = 0.95, force: bool = False) -> None:
    """Refuse a remapping that resolves nothing, or under the floor without ``force``."""
    if old_ids and (resolved == 0 or (resolved < floor * old_ids and not force)):
        raise RemapRefused(f"{resolved} of {old_ids} ids resolved")


def _clean(c: Column, allowed: list[str], most: int) -> Column:
    vals = F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim)
    return F.slice(F.array_distinct(F.filter(vals, lambda v: v.isin(*allowed))), 1, most)


def _dropped(c: Column, allowed: list[str], axis: str) -> Column:
    vals = F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim)
    return F.transform(F.filter(vals, lambda v: ~v.isin(*allowed) & (v != "")), lambda v: F.concat(F.lit(f"dropped {axis}:"), v))


def validate(answers: DataFrame, works: list[str], themes: list[str], approaches: list[str], review_below: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with repairs, rejected rows with the error).

    ``answers`` has the axes, confidence, justification, needs_review, and the flags
    ``curated`` and ``by_subject``.  Curated notices are not dropped to none but for a
    homonym or a text by the subject; texts by the subject count at most as marginal.
    """
    rel = F.trim(F.coalesce("relevance", F.lit("")))
    reason = F.when(rel != "none", F.lit("not-applicable")).otherwise(F.coalesce(F.nullif(F.trim("relevance_none_reason"), F.lit("")), F.lit("not-applicable")))
    floor = F.col("curated") & (rel == "none") & ~reason.isin("homonym", "text-by-subject")
    lifted = F.when(floor, F.lit("marginal")).otherwise(rel)
    ceiling = F.col("by_subject") & lifted.isin(*COUNTED)
    final = F.when(ceiling, F.lit("marginal")).otherwise(lifted)
    w0, t0, a0 = _clean(F.col("works"), works, 4), _clean(F.col("themes"), themes, 5), _clean(F.col("approaches"), approaches, 2)
    named = F.filter(w0, lambda v: v != "unspecified")
    w1 = F.when(F.size(w0) == 0, F.array(F.lit("unspecified"))).when((F.size(w0) > 1) & (F.size(named) > 0), named).otherwise(w0)
    t1 = F.when((F.size(t0) == 0) & (final == "marginal"), F.array(F.lit("context.biography"))).otherwise(t0)
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    off = (conf < 0) | (conf > 1)
    repairs = F.concat(
        F.array_compact(F.array(F.when(ceiling, F.lit("relevance capped at marginal")))), _dropped(F.col("works"), works, "works"), _dropped(F.col("themes"), themes, "themes"), _dropped(F.col("approaches"), approaches, "approaches"),
        F.array_compact(F.array(
            F.when(F.size(w0) == 0, F.lit("works defaulted")), F.when((F.size(w0) > 1) & (F.size(named) < F.size(w0)), F.lit("unspecified removed")), F.when((F.size(t0) == 0) & (final == "marginal"), F.lit("themes defaulted")),
            F.when(F.col("confidence").isNull(), F.lit("confidence unreadable")), F.when(off, F.lit("confidence clamped")),
        )),
    )
    error = (
        F.when(~rel.isin(*RELEVANCE), F.concat(F.lit("relevance not in vocabulary: "), rel))
        .when(~reason.isin(*NONE_REASONS), F.concat(F.lit("reason not in the closed list: "), reason))
        .when(F.size(a0) == 0, F.lit("no approach survived"))
        .when((F.size(t1) == 0) & ~final.isin("none"), F.lit("no theme survived"))
    )
    just = F.substring(F.replace(F.trim(F.coalesce("justification", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 300)
    out = answers.select(
        *[c for c in answers.columns if c not in ("relevance", "relevance_none_reason", "works", "themes", "approaches", "confidence", "justification", "needs_review")],
        error.alias("error"), final.alias("relevance"), reason.alias("relevance_none_reason"), floor.alias("floor_applied"), ceiling.alias("ceiling_applied"), w1.alias("works"), t1.alias("themes"), a0.alias("approaches"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), F.when(just == "", F.lit("no justification returned")).otherwise(just).alias("justification"), repairs.alias("repairs"),
        (F.coalesce("needs_review", F.lit(False)) | (F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)) < review_below) | (F.size(repairs) > 0) | (just == "")).alias("needs_review"),
    )
    return out.where("error is null").drop("error"), out.where("error is not null")


def classify(notices: DataFrame, classifier, schema: str) -> DataFrame:
    """Answers of an injected classifier: ``classifier(pandas batch) -> pandas batch`` in Arrow batches."""
    return notices.mapInPandas(lambda batches: (classifier(b) for b in batches), schema)


def population(notices: DataFrame, log: DataFrame) -> DataFrame:
    """Adds relevance and ``standing``: counted (core, partial), mentioned (marginal), out (none), aside (untagged)."""
    cur = latest(log).select("notice_id", "relevance")
    j = notices.join(cur, "notice_id", "left")
    return j.withColumn("standing", F.when(F.col("relevance").isin(*COUNTED), "counted").when(F.col("relevance") == "marginal", "mentioned").when(F.col("relevance") == "none", "out").otherwise("aside"))


def relevance_at_least(c: Column, least: str) -> Column:
    order = F.array(*map(F.lit, RELEVANCE))
    return F.array_position(order, c) >= RELEVANCE.index(least) + 1


def history_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Numbers the versions of each key from 1."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))
