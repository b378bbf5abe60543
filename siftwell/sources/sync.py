"""Comparing a connector's listing with what is known, and replacing what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(listing: DataFrame, known: DataFrame) -> DataFrame:
    """source_id and status: added, updated (another content_hash), unchanged or deleted."""
    both = listing.select("source_id", F.col("content_hash").alias("now"), F.lit(True).alias("listed")).join(known.select("source_id", F.col("content_hash").alias("was"), F.lit(True).alias("kept")), "source_id", "full_outer")
    status = F.when(F.col("kept").isNull(), "added").when(F.col("listed").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("updated")
    return both.select("source_id", status.alias("status"))


def guarded(listing: DataFrame, known: DataFrame) -> DataFrame:
    """As `compare`, but an empty listing deletes nothing: a folder that can't be read looks the same."""
    found = compare(listing, known)
    return found.where("status <> 'deleted'") if listing.isEmpty() else found


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` in place of rows of `old` with the same key, and all others as they were."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


STATE = ["source_id", "content_hash", "size_bytes", "modified_at", "version", "rejected_reason"]


def same(a: str, b: str) -> Column:
    """Whether size, time and version are what they were."""
    return F.col(f"{a}.size_bytes").eqNullSafe(F.col(f"{b}.size_bytes")) & F.col(f"{a}.modified_at").eqNullSafe(F.col(f"{b}.modified_at")) & F.col(f"{a}.version").eqNullSafe(F.col(f"{b}.version"))


def to_fetch(listing: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """Rows of the listing (source_id, size_bytes, modified_at, version, ready, more) whose content a pass needs: ready ones that aren't as they were and aren't larger than the limit."""
    now, was = listing.alias("now"), state.select(*STATE).alias("was")
    changed = now.join(was, F.col("now.source_id") == F.col("was.source_id"), "left").where(F.col("was.source_id").isNull() | ~same("now", "was"))
    return changed.where("now.ready AND coalesce(now.size_bytes, 0) <= " + str(int(limit))).select("now.*")


def sync_pass(listing: DataFrame, state: DataFrame, fetched: DataFrame, limit: int, keep_gone: bool = False) -> DataFrame:
    """source_id, status and reason of one pass, with the state to keep (STATE; next_* columns are null where the source is forgotten or not yet remembered).

    fetched (source_id, content_hash, rejected_reason, error): what became of the rows of `to_fetch`; `rejected_reason` is a refusal, `error` a document that can't be fetched or
    taken in. Statuses: pending (not ready; it isn't deleted either), unchanged, skipped (refused, and remembered so until it changes), failed (tried again by the next pass),
    added, updated, deleted, kept. An empty listing deletes nothing.
    """
    now, was, got = listing.alias("now"), state.select(*STATE).alias("was"), fetched.select("source_id", "content_hash", "rejected_reason", "error").alias("got")
    rows = now.join(was, F.col("now.source_id") == F.col("was.source_id"), "full_outer").join(got, F.col("now.source_id") == F.col("got.source_id"), "left")
    listed, known = F.col("now.source_id").isNotNull(), F.col("was.source_id").isNotNull()
    stored = known & F.col("was.content_hash").isNotNull()
    large = F.coalesce("now.size_bytes", F.lit(0)) > limit
    reason = F.when(large, "too_large").otherwise(F.coalesce("got.rejected_reason", "got.error"))
    gone = "kept" if keep_gone or listing.isEmpty() else "deleted"
    status = (
        F.when(~listed, gone)
        .when(~F.coalesce("now.ready", F.lit(True)), "pending")
        .when(known & same("now", "was"), "unchanged")
        .when(large | F.col("got.rejected_reason").isNotNull(), "skipped")
        .when(F.col("got.error").isNotNull() | F.col("got.source_id").isNull(), "failed")
        .when(stored & (F.col("got.content_hash") == F.col("was.content_hash")), "unchanged")
        .when(stored, "updated")
        .otherwise("added")
    )
    told = rows.withColumn("status", status).withColumn("reason", reason)
    remembered = F.col("status").isin("unchanged", "updated", "added", "skipped")
    stays = F.col("status").isin("pending", "kept")
    field = lambda c: F.when(remembered, F.col(f"now.{c}")).when(stays, F.col(f"was.{c}")).alias(f"next_{c}")
    # a refused document that was taken in before keeps its hash; one that failed is fetched again, whatever it was
    content = F.when(F.col("status").isin("updated", "added"), F.col("got.content_hash")).when(remembered | stays, F.col("was.content_hash")).alias("next_content_hash")
    refused = F.when(F.col("status") == "skipped", F.col("reason")).when(stays | ((F.col("status") == "unchanged") & F.col("got.source_id").isNull()), F.col("was.rejected_reason")).alias("next_rejected_reason")
    return told.select(F.coalesce("now.source_id", "was.source_id").alias("source_id"), "status", F.when(F.col("status").isin("skipped", "failed"), F.col("reason")).alias("reason"), content, *[field(c) for c in ("size_bytes", "modified_at", "version")], refused)


def next_state(passed: DataFrame) -> DataFrame:
    """STATE after a pass: without deleted sources and those that failed before they were ever known. Failed ones keep no marks, so they are fetched again."""
    kept = passed.where(~F.col("status").isin("deleted", "failed") & ~((F.col("status") == "pending") & F.col("next_version").isNull() & F.col("next_content_hash").isNull()))
    return kept.select("source_id", *[F.col(f"next_{c}").alias(c) for c in STATE[1:]])
