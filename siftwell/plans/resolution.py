"""Queries of entity resolution: parts as entities of their brand, orders as the chunks that name them; merges as a log, and what is there when some are taken back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import graph as G
from siftwell.operators import merge_log as M
from siftwell.operators import resolution as R
from siftwell.plans.registry import query, table

_BEST = "{c} IS NOT NULL DESC, coalesce({c}, 0) DESC, coalesce({n}, 0) DESC, {i}"
#: Every tenth part has the name of the next one as its alias.
_LOG = f"""RECURSIVE e AS (SELECT CAST(p.p_partkey AS BIGINT) AS id, p.p_brand AS type, p.p_name AS name, CASE WHEN p.p_partkey % 10 = 0 THEN n.p_name END AS alias FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1),
 s AS (SELECT CAST(l_partkey AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS chunk, max(CASE WHEN l_tax > 0 THEN l_tax END) AS conf FROM lineitem GROUP BY 1, 2),
 st AS (SELECT id, max(conf) AS conf, count(*) AS n FROM s GROUP BY id),
 r1 AS (SELECT e.*, lower(name) AS key, first_value(id) OVER (PARTITION BY type, lower(name) ORDER BY {_BEST.format(c="conf", n="n", i="id")}) AS unit FROM e LEFT JOIN st USING (id)),
 u AS (SELECT unit, max(conf) AS conf, count(DISTINCT chunk) AS n FROM r1 LEFT JOIN s USING (id) GROUP BY unit),
 k AS (SELECT type, unit, key FROM r1 UNION SELECT type, unit, lower(alias) FROM r1 WHERE alias IS NOT NULL),
 near AS (SELECT DISTINCT a.unit AS x, b.unit AS y FROM k a JOIN k b USING (type, key)),
 reach(x, y) AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
 comp AS (SELECT x AS unit, min(y) AS comp FROM reach GROUP BY x),
 r2 AS (SELECT unit, first_value(unit) OVER (PARTITION BY comp ORDER BY {_BEST.format(c="conf", n="n", i="unit")}) AS root FROM comp JOIN u USING (unit)),
 lg AS (SELECT unit AS survivor, id AS merged, 'exact' AS method FROM r1 WHERE id <> unit UNION ALL SELECT root, unit, 'alias' FROM r2 WHERE root <> unit)"""
_ROOT = "ro AS (SELECT id, CASE WHEN {undone} THEN unit ELSE root END AS root, unit FROM r1 JOIN r2 USING (unit))"
_UNDONE = "unit % 2 = 0"
_FOLDED = """ed AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey AS edge_id FROM lineitem),
 fo AS (SELECT edge_id, root AS src, -1 - b AS dst, first_value(edge_id) OVER (PARTITION BY root, b ORDER BY a = root DESC, edge_id) AS kept FROM ed JOIN ro ON a = id)"""


def _tables(spark, sf_dir):
    """entities, sources, edges from parts to suppliers, and their sources."""
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("alias")).where("p_partkey % 10 = 0")
    alias = F.when(F.col("alias").isNotNull(), F.array("alias"))
    entities = parts.join(following, "p_partkey", "left").select(F.col("p_partkey").cast("long").alias("entity_id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), alias.alias("aliases"))
    long = lambda c: F.col(c).cast("long")
    measure = F.max(F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("confidence")
    # exchanged by what their rows are joined and grouped by next, so that neither is an exchange again
    sources = lines.repartition(long("l_partkey").alias("entity_id")).groupBy(long("l_partkey").alias("entity_id"), long("l_orderkey").alias("chunk_id")).agg(measure)
    edge = long("l_partkey") * 100_000_000 + long("l_suppkey")
    stated = lines.groupBy(edge.alias("edge_id"), long("l_partkey").alias("src"), (-1 - long("l_suppkey")).alias("dst"), long("l_orderkey").alias("chunk_id")).agg(measure)
    return entities, sources, stated.select("edge_id", "src", "dst", F.lit("OWNS").alias("relation")).distinct(), stated.select("edge_id", "chunk_id", "confidence")


@query("gr07_closed_merges", f"WITH {_LOG} SELECT survivor, merged, method FROM lg")
def closed_merges(spark, sf_dir):
    entities, sources, *_ = _tables(spark, sf_dir)
    return R.by_name(entities, sources).select("survivor", "merged", "method")


def _undone(log):
    """The alias merges of entities with an even id are taken back; they are the newest."""
    return log.where("method = 'alias' AND merged % 2 = 0")


@query("gr10_merged_sources", f"WITH {_LOG}, {_ROOT.format(undone='false')} SELECT root AS entity_id, chunk AS chunk_id, max(conf) AS confidence FROM s JOIN ro USING (id) GROUP BY 1, 2")
def merged_sources(spark, sf_dir):
    entities, sources, *_ = _tables(spark, sf_dir)
    return M.merged_sources(sources, M.lineage(R.by_name(entities, sources)))


@query("gr10_merged_edges", f"WITH {_LOG}, {_ROOT.format(undone='false')}, {_FOLDED}, lx AS (SELECT CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey AS edge_id, max(CASE WHEN l_tax > 0 THEN l_tax END) AS conf FROM lineitem GROUP BY 1) SELECT kept AS edge_id, src, dst, max(conf) AS confidence FROM fo JOIN lx USING (edge_id) GROUP BY 1, 2, 3")
def merged_edges(spark, sf_dir):
    entities, sources, edges, stated = _tables(spark, sf_dir)
    measured = edges.join(stated.groupBy("edge_id").agg(F.max("confidence").alias("confidence")), "edge_id")
    return M.merged_edges(measured, M.lineage(R.by_name(entities, sources))).select("edge_id", "src", "dst", "confidence")


@query(
    "gr10_merged_aliases",
    f"""WITH {_LOG}, {_ROOT.format(undone="false")}, al AS (SELECT ro.root, ro.unit, r1.id, name, alias, CASE WHEN r1.id = ro.root THEN 0 WHEN r1.id = ro.unit OR ro.unit = ro.root THEN 1 ELSE 2 END AS depth FROM r1 JOIN ro USING (id)),
    it AS (SELECT root, name AS text, depth = 1 AS always FROM al UNION ALL SELECT root, alias, depth = 0 FROM al WHERE alias IS NOT NULL)
    SELECT root AS entity_id, count(DISTINCT text) FILTER (WHERE always OR lower(text) <> (SELECT lower(name) FROM e WHERE e.id = root)) AS n_aliases FROM it GROUP BY root""",
)
def merged_aliases(spark, sf_dir):
    """How many spellings each entity that is left answers to besides its name."""
    entities, sources, *_ = _tables(spark, sf_dir)
    return M.merged_aliases(entities, M.lineage(R.by_name(entities, sources))).select("entity_id", F.size("aliases").cast("long").alias("n_aliases"))


@query("gr11_unmerged_edges", f"WITH {_LOG}, {_ROOT.format(undone=_UNDONE)}, {_FOLDED} SELECT edge_id, src, dst, kept FROM fo")
def unmerged_edges(spark, sf_dir):
    """Edges and what they are folded into when merges have been taken back: those that these had folded are apart again."""
    entities, sources, edges, _ = _tables(spark, sf_dir)
    log = R.by_name(entities, sources)
    return M.edge_roots(edges, M.lineage(M.active(log, _undone(log)))).select("edge_id", "src", "dst", "kept")


@query(
    "gr11_undo_outcome",
    f"""WITH {_LOG}, ed AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey AS edge_id FROM lineitem),
    rb AS ({_ROOT.format(undone="false")[7:-1]}), ra AS ({_ROOT.format(undone=_UNDONE)[7:-1]}),
    ob AS (SELECT edge_id, root AS src, first_value(edge_id) OVER (PARTITION BY root, b ORDER BY a = root DESC, edge_id) = edge_id AS kept, count(*) OVER (PARTITION BY root, b) AS n FROM ed JOIN rb ON a = id),
    oa AS (SELECT edge_id, root AS src, first_value(edge_id) OVER (PARTITION BY root, b ORDER BY a = root DESC, edge_id) = edge_id AS kept, count(*) OVER (PARTITION BY root, b) AS n FROM ed JOIN ra ON a = id)
    SELECT edge_id, CASE WHEN NOT ob.kept THEN 'restored' WHEN ob.src <> oa.src THEN 'moved' ELSE 'shared' END AS outcome FROM ob JOIN oa USING (edge_id) WHERE oa.kept AND (NOT ob.kept OR ob.src <> oa.src OR ob.n <> oa.n)""",
)
def undo_outcome(spark, sf_dir):
    entities, sources, edges, stated = _tables(spark, sf_dir)
    log = R.by_name(entities, sources)
    return M.undo_outcome(edges, stated, M.lineage(log), M.lineage(M.active(log, _undone(log))))


_SIMILARITY = """round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
      / (sqrt(list_sum(list_transform(x.embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE)))) * sqrt(list_sum(list_transform(y.embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))))), 6)"""


@query(
    "gr08_greedy_matching",
    f"""WITH RECURSIVE x AS (SELECT least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b, max({_SIMILARITY}) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.vec_id % 20 = 0 GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, a, b) AS i FROM x WHERE similarity >= 0.3),
    g(i, used, hit) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false UNION ALL SELECT p.i, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM g JOIN p ON p.i = g.i + 1)
    SELECT a, b, similarity FROM p JOIN g USING (i) WHERE hit""",
)
def greedy_matching(spark, sf_dir):
    """Of the pairs between the vectors whose id is divisible by 20 and all others of their label."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = G.similar_pairs(vectors, vectors.where("vec_id % 20 = 0"), 0.3)
    return R.greedy_matching(pairs.select(F.col("vec_id").alias("a"), F.col("other").alias("b"), "similarity"))
