"""Entity merges as an append-only log. Tables are never patched: what is merged follows from the log without undone merges.

What extraction reported stays as it was reported: entity_sources (entity_id, chunk_id, confidence, surface_name), edges (src, dst, relation, edge_id)
and edge_sources (edge_id, chunk_id, confidence). So a merge that is taken back gives back sources, aliases and edges by itself, edges that it had
folded into one are apart again, and reports that came after the merge stay with the entity they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators.lineage import cut, stored


def active(log: DataFrame, undone: DataFrame) -> DataFrame:
    """merge_id, survivor, merged of merges (log) that no row of `undone` (merge_id) takes back."""
    return log.join(undone.select("merge_id"), "merge_id", "left_anti").select("merge_id", "survivor", "merged")


def lineage(merges: DataFrame) -> DataFrame:
    """entity_id, root and path (the merges on the way, the root's own first) of every merged entity, through merges of its survivor. The
    latest merge of an entity counts. Each step doubles how far an entity is followed."""
    latest = merges.groupBy(F.col("merged").alias("entity_id")).agg(F.max_by(F.struct("survivor", "merge_id"), "merge_id").alias("m"))
    found = cut(latest.select("entity_id", F.col("m.survivor").alias("root"), F.array("m.merge_id").alias("path")))
    while True:
        up = found.select(F.col("entity_id").alias("root"), F.col("root").alias("next"), F.col("path").alias("above"))
        step = cut(found.join(up, "root", "left").select("entity_id", F.coalesce("next", "root").alias("root"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path"), F.col("next").isNotNull().alias("moved")))
        if not step.where("entity_id = root").isEmpty():
            raise ValueError("the log merges entities in a circle")
        if step.where("moved").isEmpty():
            return step.select("entity_id", "root", "path")
        found = step.select("entity_id", "root", "path")


def roots(merges: DataFrame) -> DataFrame:
    """entity_id, root of every merged entity."""
    return lineage(merges).select("entity_id", "root")


def renamed(table: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The table with entity ids in the given columns replaced by their roots."""
    for c in columns:
        table = table.join(found.select(F.col("entity_id").alias(c), F.col("root").alias("__root")), c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    return table


def higher() -> tuple[Column, ...]:
    """Order of reports by confidence; unmeasured ones are the least."""
    return F.col("confidence").isNotNull(), F.coalesce("confidence", F.lit(0.0))


def merged_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each entity and chunk: the report with the highest confidence, with its surface name if there is one; of equals the root's own, then
    that of the least entity. Unmeasured only if none is measured."""
    own = [c for c in ("confidence", "surface_name") if c in sources.columns]
    rows = renamed(sources.withColumn("__from", F.col("entity_id")), found, "entity_id")
    order = F.struct(*higher(), F.col("__from") == F.col("entity_id"), -F.col("__from"))
    return rows.groupBy("entity_id", "chunk_id").agg(*[F.max_by(c, order).alias(c) for c in own])


def edge_roots(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edge_id, src, dst, relation, kept: each edge between roots, and the edge it is folded into: of those with equal ends and relation the one
    that is no other's loan (its ends are roots), then the least id. Edges that became loops are left out."""
    rows = renamed(edges.withColumn("__src", F.col("src")).withColumn("__dst", F.col("dst")), found, "src", "dst").where("src <> dst OR __src = __dst")
    order = F.struct((F.col("src") == F.col("__src")) & (F.col("dst") == F.col("__dst")), -F.col("edge_id"))
    kept = rows.groupBy("src", "dst", "relation").agg(F.max_by("edge_id", order).alias("kept"))
    return rows.join(kept, ["src", "dst", "relation"]).select("edge_id", "src", "dst", "relation", "kept")


def merged_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between roots: no loops, one for each pair and relation, with the highest confidence."""
    kept = edge_roots(edges, found)
    rows = kept.join(edges.select("edge_id", "confidence"), "edge_id")
    return rows.groupBy("src", "dst", "relation").agg(F.first("kept").alias("edge_id"), F.max("confidence").alias("confidence"))


def merged_edge_sources(edge_sources: DataFrame, kept: DataFrame) -> DataFrame:
    """edge_id, chunk_id, confidence: sources of folded edges (as of `edge_roots`) go to the edge they are folded into. With boolean columns in `kept`, instead of confidence a column for each of them:
    the struct of the confidence by its rows alone, null without any."""
    sides = [c for c in kept.columns if kept.schema[c].dataType.typeName() == "boolean"]
    rows = edge_sources.join(kept.select("edge_id", "kept", *sides), "edge_id").select(F.col("kept").alias("edge_id"), "chunk_id", "confidence", *sides)
    best = [F.max(F.when(F.col(c), F.struct("confidence"))).alias(c) for c in sides] or [F.max("confidence").alias("confidence")]
    return rows.groupBy("edge_id", "chunk_id").agg(*best)


def merged_aliases(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """entity_id, aliases of the entities (entity_id, name, aliases) that are left, in order of the merges (`lineage`).

    An entity's own aliases come first. The name of what was merged into it is added in its own spelling, also where it has the same key; what else that
    answered to is added if nothing before it has its key. Entities without aliases have an empty list.
    """
    own = entities.select("entity_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "name").join(paths, "entity_id", "left")
    own = own.select(F.coalesce("root", "entity_id").alias("root"), F.coalesce("path", F.array().cast("array<long>")).alias("path"), "name", "aliases")
    texts = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("name").alias("text"))), F.transform("aliases", lambda a, i: F.struct(i.alias("at"), a.alias("text"))))
    rows = own.select("root", "path", F.explode(texts).alias("t")).select("root", F.struct("path", "t.at").alias("place"), "t.text").where("text IS NOT NULL")
    depth, at = F.size("place.path"), F.col("place.at")
    rows = rows.withColumn("key", name_key(F.col("text"))).withColumn("always", ((depth == 1) & (at < 0)) | ((depth == 0) & (at >= 0)))
    first = F.row_number().over(Window.partitionBy("root", "key").orderBy("place")) == 1
    rows = rows.withColumn("new", first & (F.col("key") != "")).where("always OR (new AND (size(place.path) > 0))")
    rows = rows.groupBy("root", "text").agg(F.min("place").alias("place"))
    listed = rows.groupBy(F.col("root").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("aliases"))
    left = entities.select("entity_id").join(paths, "entity_id", "left_anti")
    return left.join(listed, "entity_id", "left").select("entity_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def in_force(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reports (chunk_id, digest, more) of the text that a chunk (chunk_id, digest) has now."""
    return reports.join(chunks.select("chunk_id", "digest"), ["chunk_id", "digest"], "left_semi")


def evidence(merges: DataFrame, sources: DataFrame, edges: DataFrame, edge_sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """merge_id, chunk_id, digest: the texts, as they are now, of all that the merges move. To be kept with the log when they are made."""
    moved = lineage(merges).select("entity_id", F.explode("path").alias("merge_id"))
    by_source = moved.join(sources, "entity_id").select("merge_id", "chunk_id")
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("entity_id"))
    by_edge = moved.join(ends, "entity_id").select("merge_id", "edge_id").join(edge_sources, "edge_id").select("merge_id", "chunk_id")
    return by_source.unionByName(by_edge).distinct().join(chunks.select("chunk_id", "digest"), "chunk_id").select("merge_id", "chunk_id", "digest")


def changed_chunks(kept: DataFrame, merge_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """merge_id, chunk_id of what `evidence` has of the merges and whose text is another by now, or gone: their reports don't come back."""
    now = chunks.select("chunk_id", F.col("digest").alias("now"))
    return kept.join(merge_ids.select("merge_id"), "merge_id", "left_semi").join(now, "chunk_id", "left").where("now IS NULL OR now <> digest").select("merge_id", "chunk_id")


def undo_outcome(edges: DataFrame, edge_sources: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """edge_id, outcome of the edges that an undo changes, from the roots before and after it: `moved` (it has another end), `restored` (it was folded or a loop
    and is an edge again), `shared` (it gave sources back), `unrestored` (it has no source in force any more)."""
    rows = _folded(edges, before, after)
    was, now = (F.coalesce(F.col(c) == F.col("edge_id"), F.lit(False)) for c in ("old_into", "into"))
    changed = F.col("moved") | (was != now)
    own = F.when(changed & now & ~was, "restored").when(changed & now, "moved").when(changed, "gone")
    rows = stored(rows.select("edge_id", "to_old", "to_new", own.alias("own")))
    alive = edge_sources.select("edge_id").distinct().withColumn("alive", F.lit(True))
    told = rows.where("own IS NOT NULL").select("edge_id", "own").join(alive, "edge_id", "left").select("edge_id", F.when(F.col("alive").isNull(), "unrestored").when(F.col("own") != "gone", F.col("own")).alias("outcome"))
    # a source is sent to the edges that have it before and after, in one row if they are one
    to = lambda kept, old, new: F.struct(F.col(kept).alias("kept"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    same = F.col("to_old").eqNullSafe(F.col("to_new"))
    kept = rows.select("edge_id", F.inline(F.when(same, F.array(to("to_old", True, True))).otherwise(F.array(to("to_old", True, False), to("to_new", False, True))))).where("kept IS NOT NULL")
    held = merged_edge_sources(edge_sources, kept.withColumn("itself", F.col("edge_id") == F.col("kept")))
    shared = held.groupBy("edge_id").agg(F.max(~F.col("old").eqNullSafe(F.col("new"))).alias("other"), F.max(F.col("itself").isNotNull()).alias("alive")).where("other AND alive")
    changed = rows.where("own IS NOT NULL").select("edge_id")
    # what is told of the old side may be an edge that is folded or apart now: it has an outcome of its own
    return told.where("outcome IS NOT NULL").unionByName(shared.join(changed, "edge_id", "left_anti").select("edge_id", F.lit("shared").alias("outcome")))


def _folded(edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """edge_id, moved (it has other ends), old_into and into (what it is folded into, as of `edge_roots`), and of these to_old and to_new, which may have given sources back or got some: their ends are the
    same before and after. Only edges that met one with other ends, before or after: all others hold what they held. Both sides are found along with each other, so that edges are exchanged once an end
    and once a side."""
    both = before.select("entity_id", F.col("root").alias("old")).join(after.select("entity_id", F.col("root").alias("new")), "entity_id", "full")
    rows = edges.select("edge_id", "src", "dst", "relation")
    for end in ("src", "dst"):
        rows = rows.join(both.select(F.col("entity_id").alias(end), F.col("old").alias(f"old_{end}"), F.col("new").alias(f"new_{end}")), end, "left")
        rows = rows.withColumns({f"{side}_{end}": F.coalesce(f"{side}_{end}", end) for side in ("old", "new")})
    there = lambda side: F.coalesce(F.col("relation").isNotNull() & ((F.col(f"{side}_src") != F.col(f"{side}_dst")) | (F.col("src") == F.col("dst"))), F.lit(False))
    is_own = lambda side: (F.col("src") == F.col(f"{side}_src")) & (F.col("dst") == F.col(f"{side}_dst"))
    rows = rows.select("edge_id", "relation", *[f"{side}_{end}" for side in ("old", "new") for end in ("src", "dst")], *[x(side).alias(f"{name}_{side}") for side in ("old", "new") for name, x in (("in", there), ("own", is_own))])
    moved = (F.col("in_old") != F.col("in_new")) | (F.col("in_old") & ((F.col("old_src") != F.col("new_src")) | (F.col("old_dst") != F.col("new_dst"))))
    rows = rows.withColumn("moved", moved)

    def side(rows: DataFrame, name: str, into: str, may: Column) -> DataFrame:
        """With `into`, whether an edge there has other ends, and `into` where it may be told of sources."""
        group = Window.partitionBy(f"{name}_src", f"{name}_dst", "relation")
        order = F.when(F.col(f"in_{name}"), F.struct(F.col(f"own_{name}").alias("own"), (-F.col("edge_id")).alias("least")))
        rows = rows.withColumn("__best", F.max(F.struct(order.alias("o"), may.alias("may"))).over(group)).withColumn(f"met_{name}", F.max(F.when(F.col(f"in_{name}"), F.col("moved"))).over(group))
        rows = rows.withColumn(into, F.when(F.col(f"in_{name}"), -F.col("__best.o.least"))).withColumn(f"to_{name}", F.when(F.col("__best.may"), F.col(into)))
        return rows.drop("__best", f"{name}_src", f"{name}_dst", f"own_{name}")

    rows = side(rows, "old", "old_into", ~F.col("moved"))
    rows = side(rows, "new", "into", ~F.col("moved") & (F.col("old_into") == F.col("edge_id")))
    met = F.coalesce("met_old", F.lit(False)) | F.coalesce("met_new", F.lit(False))
    return rows.where(met).select("edge_id", "moved", "old_into", "into", "to_old", "to_new")


def blocking(log: DataFrame, undone: DataFrame, merge_id: int) -> DataFrame:
    """Later merges that have to be undone before this one: those in which its survivor takes part, on either side."""
    rows = active(log, undone)
    own = rows.where(F.col("merge_id") == merge_id).select("survivor")
    later = rows.where(F.col("merge_id") > merge_id)
    as_merged = later.join(own.select(F.col("survivor").alias("merged")), "merged", "left_semi").select("merge_id")
    return later.join(own, "survivor", "left_semi").select("merge_id").unionByName(as_merged).distinct()
