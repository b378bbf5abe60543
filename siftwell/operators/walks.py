"""Walks over a graph by what each caller may read: sets of walks at once, each with its own access.

A node is there for a caller if a chunk that the caller may read is among its sources, and so is an edge. Every hop joins only what the walks have
just reached with the edges at it, and asks for the sources of these edges and of the nodes they lead to; no walk keeps more nodes than its
budget and one, so a hub's neighbours don't pile up.

walks (walk_id, all_chunks, collections, documents, denied): a caller's access; `all_chunks` or a granted collection or document admits a chunk, a denied
document's chunks never are. chunks (chunk_id, document_id, collection_id), node_sources (node_id, chunk_id, confidence, surface_name), edges (edge_id, src,
dst, relation), edge_sources (edge_id, chunk_id, confidence). Sources that have their chunk's document_id and collection_id, or their edge's src, dst and relation, aren't joined for them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.lineage import cut, stored

MOST_HOPS, BUDGET = 4, 50
#: Rows up to which walks and the nodes they have just reached are broadcast.
BROADCAST_ROWS = 100_000
# What a relation is called when it is walked back. One that isn't here is walked in its own direction only.
INVERSES = {
    "BELONGS_TO": "CONTAINS", "MEMBER_OF": "HAS_MEMBER", "OWNS": "OWNED_BY", "WORKS_ON": "HAS_CONTRIBUTOR", "LOCATED_IN": "LOCATION_OF", "AUTHORED": "AUTHORED_BY", "MENTIONS": "MENTIONED_IN", "RELATED_TO": "RELATED_TO",
}


def inverse(relation: Column) -> Column:
    """The name of a relation walked back; null if it isn't."""
    return F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])[relation]


def admits() -> Column:
    """Whether a walk's access admits a chunk. Null lists grant and deny nothing."""
    has = lambda names, value: F.coalesce(F.array_contains(names, F.col(value)), F.lit(False))
    return (F.coalesce("all_chunks", F.lit(False)) | has("collections", "collection_id") | has("documents", "document_id")) & ~has("denied", "document_id")


class Walks:
    """Walks of one graph.

    Whether a walk sees a node or an edge follows from the collections and documents of its sources: `nodes` (node_id, collection_id, document_id) and `ways` (at, node_id,
    collection_id, document_id: where an edge may be walked from and to) have each of them once, and of a collection's documents no more than decide, so that a hub isn't
    met with all of its chunks. They are stored once for all hops.
    """

    def __init__(self, walks: DataFrame, chunks: DataFrame, node_sources: DataFrame, edges: DataFrame, edge_sources: DataFrame, relations: list[str] | None = None):
        self.walks = walks.select("walk_id", "all_chunks", "collections", "documents", "denied")
        self.chunks = chunks.select("chunk_id", "document_id", "collection_id")
        self.node_sources = node_sources
        ends = edge_sources if {"src", "dst", "relation"} <= set(edge_sources.columns) else edge_sources.join(edges.select("edge_id", "src", "dst", "relation"), "edge_id")
        #: What the sources say of edges: edge_id, src, dst, relation, chunk_id, confidence.
        self.told = ends.where(F.col("relation").isin(relations)) if relations else ends
        size = lambda c: F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.size(F.array_distinct(c)))), F.lit(0))
        row = self.walks.agg(F.count("*").alias("n"), size("denied").alias("denied"), size("documents").alias("documents")).first()
        #: Documents of a collection that decide: one more than a walk is denied. All, if walks are granted single ones.
        self.enough = None if row.documents else row.denied + 1
        self.few = row.n <= BROADCAST_ROWS

    def _known(self, sources: DataFrame) -> DataFrame:
        """Sources with their chunk's document_id and collection_id."""
        return sources if {"document_id", "collection_id"} <= set(sources.columns) else sources.join(self.chunks, "chunk_id")

    def _access(self, sources: DataFrame, *key: str) -> DataFrame:
        """The key columns, collection_id and document_id of sources (key, chunk_id), each once and no more documents of a collection than are enough."""
        rows = self._known(sources).select(*key, "collection_id", "document_id")
        if self.enough is not None:
            place = F.dense_rank().over(Window.partitionBy(*key, "collection_id").orderBy("document_id"))
            rows = rows.withColumn("__place", place).where(F.col("__place") <= self.enough).drop("__place")
        return rows.distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(self._access(self.node_sources, "node_id"))

    @cached_property
    def ways(self) -> DataFrame:
        return stored(self._access(self.told.withColumn("back", inverse(F.col("relation")).isNotNull()), "src", "dst", "back"))

    def _visible(self, items: DataFrame, access: DataFrame, key: str) -> DataFrame:
        """Rows of items (walk_id, key) with those of access (key, collection_id, document_id) that the walk may read. Few walks are broadcast; else each item brings its walk's access along."""
        if self.few:
            return items.join(access, key).join(F.broadcast(self.walks), "walk_id").where(admits())
        return items.join(self.walks, "walk_id").join(access, key).where(admits())

    def seen_nodes(self, nodes: DataFrame) -> DataFrame:
        """walk_id, node_id of the nodes that the walk may see."""
        return self._visible(nodes.select("walk_id", "node_id"), self.nodes, "node_id").select("walk_id", "node_id").distinct()

    def steps(self, frontier: DataFrame) -> DataFrame:
        """walk_id, node_id of where the edges at the frontier that the walk may see lead, each way that they may be walked."""
        at = frontier.select("walk_id", F.col("node_id").alias("at"))
        if frontier.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            at = F.broadcast(at)
        ahead = self.ways.select(F.col("src").alias("at"), F.col("dst").alias("node_id"), "collection_id", "document_id")
        back = self.ways.where("back").select(F.col("dst").alias("at"), F.col("src").alias("node_id"), "collection_id", "document_id")
        return self._visible(at, ahead.unionByName(back), "at").select("walk_id", "node_id").distinct()

    def reach(self, seeds: DataFrame, hops: int = 2, budget: int = BUDGET) -> DataFrame:
        """walk_id, node_id, depth, truncated: at most `budget` nodes a walk, nearest first and then by id, and whether more were reached. Seeds (walk_id, node_id) that
        the walk may not see aren't reached."""
        if not 1 <= hops <= MOST_HOPS or budget < 1:
            raise ValueError(f"hops go from 1 to {MOST_HOPS}, and the budget is 1 at least")
        first = Window.partitionBy("walk_id").orderBy("depth", "node_id")

        def some(nodes: DataFrame, depth: int) -> DataFrame:
            """One node more than the budget at most: what comes after it in a hop is never kept."""
            rows = nodes.withColumn("depth", F.lit(depth).cast("long")).withColumn("place", F.row_number().over(first))
            return cut(rows.where(F.col("place") <= budget + 1).drop("place"))

        reached = frontier = some(self.seen_nodes(seeds.distinct()), 0)
        for depth in range(1, hops + 1):
            full = reached.groupBy("walk_id").count().where(F.col("count") > budget).select("walk_id")
            going = cut(frontier.join(full, "walk_id", "left_anti"))
            steps = self.steps(going).join(reached.select("walk_id", "node_id"), ["walk_id", "node_id"], "left_anti")
            frontier = some(self.seen_nodes(steps), depth)
            reached = cut(reached.unionByName(frontier))
        sized = reached.withColumn("truncated", F.count("*").over(Window.partitionBy("walk_id")) > budget)
        return cut(sized.withColumn("place", F.row_number().over(first)).where(F.col("place") <= budget).select("walk_id", "node_id", "depth", "truncated"))

    def edges_among(self, reached: DataFrame, hops: int = 2) -> DataFrame:
        """walk_id, k, edge_id, src, dst, relation, walked_as, reversed, confidence, chunk_ids of the edges that a walk could have used among the nodes it reached.

        An edge is walked from a node before the last hop: ahead if its source is one, else back, under the inverse name, if its target is one. Confidence is
        the highest that the admitted sources measured, null if none did, and chunk_ids are these sources; k numbers a walk's edges by id.
        """
        before = F.col("depth") < hops
        ends = reached.groupBy("walk_id").agg(F.collect_list(F.when(before, F.col("node_id"))).alias("near"), F.collect_list(F.when(~before, F.col("node_id"))).alias("last"))
        # a walk's nodes come along with each of them, so that of the many edges at a node only those that lead to another of its nodes go on
        at = reached.select("walk_id", F.col("node_id").alias("src"), before.alias("ahead")).join(ends, "walk_id")
        known = self._known(self.told).select("src", "dst", "edge_id", "relation", "chunk_id", "confidence", "collection_id", "document_id")
        near, last = F.array_contains("near", F.col("dst")), F.array_contains("last", F.col("dst"))
        used = F.when(F.col("ahead"), near | last).otherwise(near & inverse(F.col("relation")).isNotNull())
        read = self._visible(at, known, "src").where(used).groupBy("walk_id", "edge_id", "src", "dst", "relation", (~F.col("ahead")).alias("reversed"))
        read = read.agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
        named = F.when(F.col("reversed"), inverse(F.col("relation"))).otherwise(F.col("relation"))
        k = F.row_number().over(Window.partitionBy("walk_id").orderBy("edge_id")).cast("long")
        return read.select("walk_id", k.alias("k"), "edge_id", "src", "dst", "relation", named.alias("walked_as"), "reversed", "confidence", "chunk_ids")

    @cached_property
    def spellings(self) -> DataFrame:
        """node_id, collection_id, document_id, best: the best source of a node in a document; of a collection's documents those with the best ones, no more than are enough."""
        best = F.struct(F.col("confidence").isNotNull().alias("measured"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (-F.col("chunk_id")).alias("earliest"), F.col("surface_name").alias("name"))
        rows = self._known(self.node_sources).repartition("node_id", "collection_id").groupBy("node_id", "collection_id", "document_id").agg(F.max(best).alias("best"))
        if self.enough is not None:
            place = F.row_number().over(Window.partitionBy("node_id", "collection_id").orderBy(F.col("best").desc()))
            rows = rows.withColumn("__place", place).where(F.col("__place") <= self.enough).drop("__place")
        return rows

    def names(self, reached: DataFrame) -> DataFrame:
        """walk_id, node_id, name: the spelling of the most confident source that the walk may read, of equals the earliest chunk's."""
        read = self._visible(reached.select("walk_id", "node_id"), self.spellings, "node_id")
        return read.groupBy("walk_id", "node_id").agg(F.max("best")["name"].alias("name"))

    def empty_reasons(self, seeds: DataFrame, reached: DataFrame, edges: DataFrame) -> DataFrame:
        """walk_id, reason: why a walk has no edges; null if it has some. A walk without a visible seed matched nothing."""
        rows = self.walks.select("walk_id").join(reached.select("walk_id").distinct().withColumn("met", F.lit(True)), "walk_id", "left").join(edges.select("walk_id").distinct().withColumn("walked", F.lit(True)), "walk_id", "left")
        return rows.select("walk_id", F.when(F.col("walked"), None).when(F.col("met"), "no_walkable_edges").otherwise("no_entity_matched").alias("reason"))
