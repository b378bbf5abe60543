"""Knowledge-graph operators over entity, relation and provenance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators.lineage import cut
from siftwell.operators.ranking import cosine_at_least

#: Relations that are walked in their own direction only.
ONE_WAY = ["REPORTS_TO"]
HOPS, BUDGET = 2, 50


def walk_edges(edges: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """Directed steps (src, dst, edge_id, relation, reversed) between visible nodes. Two equi-joinable parts instead of an
    either-way condition."""
    if denied is not None:
        for end in ("src", "dst"):
            edges = edges.join(denied.select(F.col("node_id").alias(end)), end, "left_anti")
    cols = ["src", "dst", "edge_id", "relation"]
    back = edges.where(~F.col("relation").isin(ONE_WAY)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "relation")
    return edges.select(*cols, F.lit(False).alias("reversed")).unionByName(back.withColumn("reversed", F.lit(True)))


def walk(seeds: DataFrame, steps: DataFrame, hops: int = HOPS, budget: int | None = BUDGET) -> DataFrame:
    """node_id, depth of what is reached, nearest first, at most `budget` nodes. Up to four hops.

    Each hop is one join of the edges with the frontier, which is written out, so a plan holds one hop whatever their number.
    """
    if not 1 <= hops <= 4:
        raise ValueError("hops go from 1 to 4")
    reached = frontier = cut(seeds.select("node_id").distinct().withColumn("depth", F.lit(0).cast("long")))
    for depth in range(1, hops + 1):
        near = frontier.join(steps, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct()
        frontier = cut(near.join(reached.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        reached = reached.unionByName(frontier)
    return reached if budget is None else reached.orderBy("depth", "node_id").limit(budget)


def edges_among(edges: DataFrame, reached: DataFrame, hops: int = HOPS) -> DataFrame:
    """edge_id, reversed of the edges that a walk could have used among the nodes it reached: ahead from a source before the hop limit, else back
    from such a target unless the relation goes one way only."""
    ends = edges.join(reached.select(F.col("node_id").alias("src"), F.col("depth").alias("ds")), "src").join(reached.select(F.col("node_id").alias("dst"), F.col("depth").alias("dd")), "dst")
    back = (F.col("dd") < hops) & ~F.col("relation").isin(ONE_WAY)
    return ends.where((F.col("ds") < hops) | back).select("edge_id", (F.col("ds") >= hops).alias("reversed"))


def upserted(mentions: DataFrame, floor: float = 0.5) -> DataFrame:
    """Entities of mentions (type, name, chunk_id, confidence) over a confidence floor: one for each type and key."""
    kept = mentions.where(F.col("confidence") >= floor).withColumn("key", name_key(F.col("name")))
    return kept.groupBy("type", "key").agg(F.countDistinct("chunk_id").alias("n_sources"), F.max("confidence").alias("confidence"), F.min("name").alias("name"))


def survivors(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Of entities with equal keys: the one with a confidence, the highest, most sources and least id; and how many go into it."""
    order = F.struct(F.col("confidence").isNotNull(), F.coalesce("confidence", F.lit(0.0)), "n_sources", (-F.col("entity_id")))
    return entities.groupBy(*keys).agg(F.max_by("entity_id", order).alias("survivor_id"), F.count("*").alias("n_merged"))


def best_names(sources: DataFrame) -> DataFrame:
    """The surface name of each entity's most confident source, the earliest chunk among equals."""
    order = F.struct(F.col("confidence").isNotNull(), F.coalesce("confidence", F.lit(0.0)), -F.col("chunk_id"))
    return sources.groupBy("entity_id").agg(F.max_by("surface_name", order).alias("name"))


def similar_pairs(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """vec_id, other, similarity of a stated set of queries and all vectors (vec_id, embedding, label) of the same label with a cosine of
    the threshold or more; a pair of two queries comes once from each. Queries go to the tasks in blocks of bounded size."""
    found = cosine_at_least(vectors, queries.select(F.col("vec_id").alias("query_id"), "embedding", "label"), threshold)
    return found.where("query_id <> vec_id").select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), F.col("score").alias("similarity"))


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id of chunks whose text stayed: the k-th of a text in a document goes to the k-th."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("chunk_id"))
    a = old.select("doc_id", "digest", F.col("chunk_id").alias("old_id"), nth.alias("k"))
    return a.join(new.select("doc_id", "digest", F.col("chunk_id").alias("new_id"), nth.alias("k")), ["doc_id", "digest", "k"]).select("doc_id", "old_id", "new_id")
