"""Queries of a sync pass: documents as what a connector lists, an older view of them as what is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.plans.registry import query, table
from siftwell.sources import sync as S

_LIMIT = 8000
_PASS = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id, n_chars AS size, lang AS version, doc_id % 11 <> 0 AS ready, md5(text) AS hash FROM documents),
 was AS (SELECT source_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN md5('old') ELSE hash END AS hash, CASE WHEN doc_id % 3 = 0 THEN size - 1 ELSE size END AS size, version, CASE WHEN doc_id % 13 = 0 THEN 'binary' END AS reason FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gone ' || doc_id, doc_id, hash, size, version, NULL FROM d WHERE doc_id % 50 = 0),
 p AS (SELECT coalesce(d.source_id, was.source_id) AS source_id, d.size, was.size AS old_size, was.hash AS old_hash, was.reason AS old_reason, d.version, was.version AS old_version, d.hash, CASE WHEN d.size > {_LIMIT} THEN 'too_large' WHEN d.doc_id % 17 = 0 THEN 'binary' END AS refused, CASE WHEN d.doc_id % 19 = 0 THEN 'could not fetch' END AS error,
  CASE WHEN d.source_id IS NULL THEN 'deleted' WHEN NOT d.ready THEN 'pending' WHEN was.source_id IS NOT NULL AND was.size = d.size THEN 'unchanged' WHEN d.size > {_LIMIT} OR d.doc_id % 17 = 0 THEN 'skipped' WHEN d.doc_id % 19 = 0 THEN 'failed' WHEN was.hash = d.hash THEN 'unchanged' WHEN was.hash IS NOT NULL THEN 'updated' ELSE 'added' END AS status
  FROM d FULL JOIN was USING (source_id))"""


def _pass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("size_bytes"), F.md5("text").alias("hash"))
    ident, never = F.col("doc_id").cast("string"), F.lit(None).cast("timestamp")
    listing = docs.select(ident.alias("source_id"), "doc_id", "size_bytes", never.alias("modified_at"), F.col("lang").alias("version"), (F.col("doc_id") % 11 != 0).alias("ready"), "hash")
    refused = F.col("doc_id") % 13 == 0
    known = docs.where("doc_id % 5 <> 0").select(
        ident.alias("source_id"), F.when(~refused, F.when(F.col("doc_id") % 6 == 0, F.md5(F.lit("old"))).otherwise(F.col("hash"))).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        never.alias("modified_at"), F.col("lang").alias("version"), F.when(refused, "binary").alias("rejected_reason"),
    )
    gone = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("gone "), ident).alias("source_id"), F.col("hash").alias("content_hash"), "size_bytes", never.alias("modified_at"), F.col("lang").alias("version"), F.lit(None).cast("string").alias("rejected_reason"))
    state = known.unionByName(gone)
    wanted = S.to_fetch(listing, state, _LIMIT)
    odd = lambda n, what: F.when(F.col("doc_id") % n == 0, what)
    fetched = wanted.select("source_id", F.col("hash").alias("content_hash"), odd(17, "binary").alias("rejected_reason"), odd(19, "could not fetch").alias("error"))
    return S.sync_pass(listing, state, fetched, _LIMIT)


@query("st_sync_pass", f"WITH {_PASS} SELECT source_id, status, CASE WHEN status = 'skipped' THEN refused WHEN status = 'failed' THEN error END AS reason FROM p")
def sync_pass(spark, sf_dir):
    return _pass(spark, sf_dir).select("source_id", "status", "reason")


@query(
    "st_sync_state",
    f"""WITH {_PASS} SELECT source_id, CASE WHEN status IN ('updated', 'added') THEN hash ELSE old_hash END AS content_hash, CASE WHEN status = 'pending' THEN old_size ELSE size END AS size_bytes,
    CASE WHEN status = 'skipped' THEN refused WHEN status = 'pending' OR (status = 'unchanged' AND old_size = size) THEN old_reason END AS rejected_reason FROM p WHERE status NOT IN ('deleted', 'failed') AND NOT (status = 'pending' AND old_version IS NULL)""",
)
def sync_state(spark, sf_dir):
    """What is known after the pass."""
    return S.next_state(_pass(spark, sf_dir)).select("source_id", "content_hash", "size_bytes", "rejected_reason")
