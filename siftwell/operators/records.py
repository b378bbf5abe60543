"""Tables of records: pages, latest rows, unions, visibility by provenance, headings in force, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_after(rows: DataFrame, key: str, last=None, n: int = 100) -> DataFrame:
    """The next n rows by key after the last one seen (from the beginning if none was)."""
    return (rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(n)


def newest(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows in falling order of the keys, all or the first n."""
    ordered = rows.orderBy(*[F.desc(k) for k in keys])
    return ordered if n is None else ordered.limit(n)


def firsts(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each set of keys, the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_phases(runs: DataFrame, phases: list[str]) -> DataFrame:
    """document_id and the greatest run_id of each phase (null: none) of runs (run_id, document_id, phase), in one aggregation."""
    return runs.groupBy("document_id").agg(*[F.max(F.when(F.col("phase") == p, F.col("run_id"))).alias(p) for p in phases])


def merged_subgraphs(parts: DataFrame) -> DataFrame:
    """The union by id of walks (part, id, and more columns); of rows with one id, that of the last part."""
    return firsts(parts, ["id"], [F.desc("part")])


def visible(items: DataFrame, sources: DataFrame, admitted: DataFrame) -> DataFrame:
    """Items (id) that have a source (id, chunk_id) among the admitted chunks (chunk_id)."""
    return items.join(sources.join(admitted.select("chunk_id"), "chunk_id", "left_semi").select("id"), "id", "left_semi")


def scoped(allowed: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """What is allowed and within a key's scope; no scope leaves all, an empty one nothing."""
    return allowed if scope is None else allowed.join(scope.select(key), key, "left_semi")


def headings_in_force(points: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, start, more) with `section`: the title of the last of headings (keys, start, title) that starts at or before
    each of them, null if none does. One sort of both together, no range join."""
    own = [c for c in points.columns if c not in (*keys, "start")]
    a = points.select(*keys, "start", F.struct(*own).alias("own"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"))
    b = headings.select(*keys, "start", F.lit(None).cast(a.schema["own"].dataType).alias("own"), F.lit(0).alias("kind"), "title")
    last = F.last("title", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("section", last).where("kind = 1").select(*keys, "start", "own.*", "section")


def without_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """All tables without rows of the documents in `gone`. Rows without a document stay."""
    return {name: rows.join(gone.select(key), key, "left_anti") for name, rows in tables.items()}


def stuck(rows: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Rows that have been indexing since longer than this."""
    return rows.where((F.col("status") == "indexing") & (F.col("created_at") < now - F.make_dt_interval(secs=F.lit(seconds))))


def fingerprint(files: DataFrame) -> DataFrame:
    """A short name of the contents of a set of files (group_id, name, content): twelve digits of sha256 over names and contents in
    order of name. For sets of files that fit in a row; equal names are taken in order of content."""
    listed = F.sort_array(F.collect_list(F.struct("name", "content")))
    return files.groupBy("group_id").agg(F.substring(F.sha2(F.array_join(F.transform(listed, lambda f: F.concat(f["name"], f["content"])), ""), 256), 1, 12).alias("fingerprint"))


def expanded(hits: DataFrame, chunks: DataFrame, docs: DataFrame, n: int = 1) -> DataFrame:
    """hits (doc_id, chunk_index) with start, end and text of what the n chunks before and after each span together with it, every character once: chunks (doc_id, chunk_index, char_start,
    char_end) overlap, so the text comes from the document (doc_id, text). Chunks that aren't there are left out."""
    at = F.col("chunk_index").cast("long")
    near = hits.select("doc_id", at.alias("hit"), F.explode(F.sequence(at - n, at + n)).alias("chunk_index"))
    spans = near.join(chunks.select("doc_id", at.alias("chunk_index"), "char_start", "char_end"), ["doc_id", "chunk_index"]).groupBy("doc_id", "hit").agg(F.min("char_start").cast("int").alias("start"), F.max("char_end").cast("int").alias("end"))
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.col("hit").alias("chunk_index"), "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"))
