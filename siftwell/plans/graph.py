"""Queries over a graph of places, customers, suppliers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators import graph as G
from siftwell.operators.mentions import match_mentions as matched
from siftwell.plans.registry import query, table

#: Node ids: regions from 0, nations from 100, customers from 1,000, suppliers from 10,000,000,000.
_SUPPLIER = 10_000_000_000
_EDGES = f"""edges AS (SELECT CAST(1000 + c_custkey AS BIGINT) AS src, CAST(100 + c_nationkey AS BIGINT) AS dst, 'LOCATED_IN' AS relation, CAST(c_custkey AS BIGINT) AS edge_id FROM customer
  UNION ALL SELECT {_SUPPLIER} + s_suppkey, 100 + s_nationkey, 'LOCATED_IN', {_SUPPLIER} + s_suppkey FROM supplier
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, 'LOCATED_IN', -1 - n_nationkey FROM nation
  UNION ALL SELECT 1000 + c_custkey, 1000 + c_custkey // 2, 'REPORTS_TO', 2 * {_SUPPLIER} + c_custkey FROM customer WHERE c_custkey > 1)"""


def _walk(hops: int, denied: str = "false") -> str:
    return f"""RECURSIVE {_EDGES}, ok AS (SELECT * FROM edges WHERE NOT ({denied.format(n="src")}) AND NOT ({denied.format(n="dst")})),
 steps AS (SELECT src, dst FROM ok UNION ALL SELECT dst, src FROM ok WHERE relation <> 'REPORTS_TO'),
 w(node_id, depth) AS (SELECT CAST(1000 + c_custkey AS BIGINT), CAST(0 AS BIGINT) FROM customer WHERE c_custkey % 20 = 0 UNION SELECT dst, depth + 1 FROM w JOIN steps ON src = node_id WHERE depth < {hops}),
 r AS (SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id)"""


def _graph(spark, sf_dir):
    long = lambda c, plus=0: (F.col(c).cast("long") + plus)
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    edge = lambda df, src, dst, rel, ident: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("relation"), ident.alias("edge_id"))
    return (
        edge(c, long("c_custkey", 1000), long("c_nationkey", 100), "LOCATED_IN", long("c_custkey"))
        .unionByName(edge(s, long("s_suppkey", _SUPPLIER), long("s_nationkey", 100), "LOCATED_IN", long("s_suppkey", _SUPPLIER)))
        .unionByName(edge(n, long("n_nationkey", 100), long("n_regionkey"), "LOCATED_IN", -1 - long("n_nationkey")))
        .unionByName(edge(c.where("c_custkey > 1"), long("c_custkey", 1000), F.floor(F.col("c_custkey") / 2).cast("long") + 1000, "REPORTS_TO", long("c_custkey", 2 * _SUPPLIER)))
    )


def _seeds(spark, sf_dir):
    """Customers whose id is divisible by 20."""
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select((F.col("c_custkey").cast("long") + 1000).alias("node_id"))


@query("gr13_bounded_walk", f"WITH {_walk(2)} SELECT node_id, depth FROM r")
def bounded_walk(spark, sf_dir):
    return G.walk(_seeds(spark, sf_dir), G.walk_edges(_graph(spark, sf_dir)), 2, None)


@query("gr13_node_budget", f"WITH {_walk(2)} SELECT node_id, depth FROM r ORDER BY depth, node_id LIMIT 500")
def node_budget(spark, sf_dir):
    return G.walk(_seeds(spark, sf_dir), G.walk_edges(_graph(spark, sf_dir)), 2, 500)


@query("gr13_walk_denied", f"WITH {_walk(2, '{n} BETWEEN 100 AND 110 OR {n} = 1002')} SELECT node_id, depth FROM r")
def walk_denied(spark, sf_dir):
    """Denied nodes are never reached and never carry the walk."""
    edges = _graph(spark, sf_dir)
    denied = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).where("node_id BETWEEN 100 AND 110 OR node_id = 1002").distinct()
    return G.walk(_seeds(spark, sf_dir), G.walk_edges(edges, denied), 2, None)


@query("gr14_edges", f"WITH {_walk(2)} SELECT edge_id, a.depth = 2 AS reversed FROM edges JOIN r a ON a.node_id = src JOIN r b ON b.node_id = dst WHERE a.depth < 2 OR (b.depth < 2 AND relation <> 'REPORTS_TO')")
def edges(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return G.edges_among(graph, G.walk(_seeds(spark, sf_dir), G.walk_edges(graph), 2, None))


_MENTIONS = "m AS (SELECT p_type AS type, p_name AS name, CAST(l_orderkey AS BIGINT) AS chunk_id, round(1 - l_discount * 8, 2) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey)"
_KEY = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '[.,;:!? ]+$', ''), '^[\"'']+|[\"'']+$', '', 'g'))"


@query("gr02_entity_upsert", f"WITH {_MENTIONS} SELECT type, {_KEY.format(c='name')} AS key, count(DISTINCT chunk_id) AS n_sources, max(confidence) AS confidence, min(name) AS name FROM m WHERE confidence >= 0.5 GROUP BY 1, 2")
def entity_upsert(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("chunk_id"), F.round(1 - F.col("l_discount") * 8, 2).alias("confidence"))
    return G.upserted(rows.join(parts, "l_partkey"))


@query(
    "gr04_carry_chunks",
    """WITH o AS (SELECT doc_id, u.i AS chunk_id, md5(u.line) AS digest FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
    n AS (SELECT doc_id, chunk_id + 1000 AS chunk_id, digest FROM o WHERE chunk_id > 1),
    a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY chunk_id) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY chunk_id) AS k FROM n)
    SELECT a.doc_id, a.chunk_id AS old_id, b.chunk_id AS new_id FROM a JOIN b ON a.doc_id = b.doc_id AND a.digest = b.digest AND a.k = b.k""",
)
def carry_chunks(spark, sf_dir):
    """Lines as chunks; the new revision has lost its first line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    old = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk_id"), F.md5("line").alias("digest"))
    return G.carried(old, old.where("chunk_id > 1").withColumn("chunk_id", F.col("chunk_id") + 1000))


@query("gr05_orphans", "SELECT CAST(p_partkey AS BIGINT) AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IS NOT NULL)")
def orphans(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("entity_id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("entity_id")).join(sources, "entity_id", "left_anti")


_PARTS = "e AS (SELECT CAST(p_partkey AS BIGINT) AS entity_id, p_brand AS type, p_name, CASE WHEN p_size > 10 THEN p_size / 50.0 END AS confidence, CAST(p_size AS BIGINT) AS n_sources FROM part)"


def _parts(spark, sf_dir):
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("entity_id"), F.col("p_brand").alias("type"), "p_name", F.when(size > 10, size / 50.0).alias("confidence"), size.alias("n_sources"))


_RANK = "row_number() OVER (PARTITION BY {k} ORDER BY confidence IS NOT NULL DESC, coalesce(confidence, 0) DESC, n_sources DESC, entity_id)"


@query(
    "gr06_exact_resolution",
    f"WITH {_PARTS}, k AS (SELECT *, {_KEY.format(c='p_name')} AS key FROM e) SELECT type, key, max(entity_id) FILTER (WHERE rn = 1) AS survivor_id, count(*) AS n_merged FROM (SELECT *, {_RANK.format(k='type, key')} AS rn FROM k) GROUP BY type, key HAVING count(*) > 1",
)
def exact_resolution(spark, sf_dir):
    return G.survivors(_parts(spark, sf_dir).withColumn("key", name_key(F.col("p_name"))), ["type", "key"]).where("n_merged > 1")


@query(
    "gr07_alias_resolution",
    f"WITH {_PARTS}, k AS (SELECT e.*, u.alias AS key FROM e, unnest(string_split(lower(p_name), ' ')) AS u(alias)) SELECT type, key, max(entity_id) FILTER (WHERE rn = 1) AS survivor_id, count(*) AS n_merged FROM (SELECT *, {_RANK.format(k='type, key')} AS rn FROM k) GROUP BY type, key HAVING count(*) > 1",
)
def alias_resolution(spark, sf_dir):
    """Words of a name as its aliases: what each alias of a type would be merged into."""
    keys = _parts(spark, sf_dir).select("entity_id", "type", "confidence", "n_sources", F.explode(F.split(F.lower("p_name"), " ")).alias("key"))
    return G.survivors(keys, ["type", "key"]).where("n_merged > 1")


@query(
    "gr08_similar_pairs",
    """SELECT vec_id, other, similarity FROM (SELECT x.vec_id AS vec_id, y.vec_id AS other, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
      / (sqrt(list_sum(list_transform(x.embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE)))) * sqrt(list_sum(list_transform(y.embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))))), 6) AS similarity
      FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.vec_id % 20 = 0) WHERE similarity >= 0.3""",
)
def similar_pairs(spark, sf_dir):
    """Of the vectors whose id is divisible by 20, with all others of their label."""
    vectors = table(spark, sf_dir, "embeddings")
    return G.similar_pairs(vectors, vectors.where("vec_id % 20 = 0"), 0.3)


_NAMES = "s AS (SELECT CAST(l_partkey AS BIGINT) AS entity_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS chunk_id, l_returnflag || l_linestatus AS surface_name, CASE WHEN l_tax > 0 THEN l_tax END AS confidence FROM lineitem)"


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("long").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("chunk_id"), F.concat("l_returnflag", "l_linestatus").alias("surface_name"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("confidence"),
    )


@query("gr15_surface_names", f"WITH {_NAMES} SELECT entity_id, surface_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence IS NOT NULL DESC, coalesce(confidence, 0) DESC, chunk_id) AS rn FROM s) WHERE rn = 1")
def surface_names(spark, sf_dir):
    return G.best_names(_sources(spark, sf_dir))


@query("gr16_source_chunks", f"WITH {_NAMES} SELECT entity_id, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk FROM s GROUP BY entity_id")
def source_chunks(spark, sf_dir):
    return _sources(spark, sf_dir).groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query(
    "gr12_match_mentions",
    """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS entity_id, lower(n_name) AS key FROM nation UNION ALL SELECT 1000 + CAST(p_partkey AS BIGINT), lower(p_name) FROM part),
    m AS (SELECT n_name AS mention FROM nation WHERE n_nationkey % 20 = 0 UNION SELECT 'the ' || n_name FROM nation WHERE n_nationkey % 20 = 0 UNION SELECT 'An ' || p_name || '!' FROM part WHERE p_partkey % 20 = 0 UNION SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 20 = 0 UNION SELECT 'no such ' || p_name FROM part WHERE p_partkey % 40 = 0),
    k AS (SELECT mention, regexp_replace(lower(mention), '!$', '') AS key, regexp_replace(regexp_replace(lower(mention), '!$', ''), '^(the|a|an) ', '') AS core FROM m),
    f AS (SELECT mention, entity_id, min(CASE WHEN k.key = n.key THEN 1 WHEN core = n.key THEN 3 ELSE 4 END) AS rung FROM k JOIN n ON k.key = n.key OR core = n.key OR contains(' ' || core || ' ', ' ' || n.key || ' ') OR contains(' ' || n.key || ' ', ' ' || core || ' ') GROUP BY 1, 2)
    SELECT mention, entity_id, CAST(rung AS BIGINT) AS rung FROM f QUALIFY rung = min(rung) OVER (PARTITION BY mention)""",
)
def match_mentions(spark, sf_dir):
    """Names of nations and parts with an id divisible by 20, whole, with small words and marks, in part and with words around them, against all names."""
    nations, parts = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    spelt = nations.select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("surface_name"))
    spelt = spelt.unionByName(parts.select((F.col("p_partkey") + 1000).cast("long").alias("entity_id"), F.col("p_name").alias("surface_name"))).withColumn("entity_type", F.lit("any"))
    some, own = nations.where("n_nationkey % 20 = 0"), parts.where("p_partkey % 20 = 0")
    said = [some.select(F.col("n_name").alias("name")), some.select(F.concat(F.lit("the "), "n_name")), own.select(F.concat(F.lit("An "), "p_name", F.lit("!"))), own.select(F.split("p_name", " ")[0]), parts.where("p_partkey % 40 = 0").select(F.concat(F.lit("no such "), "p_name"))]
    mentions = reduce(DataFrame.union, said).distinct().select(F.col("name").alias("mention_id"), "name", F.lit(None).cast("string").alias("entity_type"))
    found = matched(mentions, spelt)
    return found.select(F.col("mention_id").alias("mention"), "entity_id", F.col("step").cast("long").alias("rung"))


@query(
    "tk05_graph_evidence",
    f"""WITH {_walk(2)} SELECT * FROM (SELECT row_number() OVER (ORDER BY depth, c_custkey) AS rank, CAST(c_custkey AS BIGINT) AS chunk_id, depth AS graph_depth FROM r JOIN customer ON 1000 + c_custkey = node_id) WHERE rank <= 10""",
)
def graph_evidence(spark, sf_dir):
    from pyspark.sql import Window

    reached = G.walk(_seeds(spark, sf_dir), G.walk_edges(_graph(spark, sf_dir)), 2, None)
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("chunk_id"), (F.col("c_custkey") + 1000).alias("node_id"))
    top = reached.join(chunks, "node_id").select("chunk_id", F.col("depth").alias("graph_depth")).orderBy("graph_depth", "chunk_id").limit(10)
    return top.select(F.row_number().over(Window.orderBy("graph_depth", "chunk_id")).cast("long").alias("rank"), "chunk_id", "graph_depth")


