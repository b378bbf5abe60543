"""Claims about relations, held against the edges that a walk found and the passages that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators.lineage import cut

EDGE_MARK, PASSAGE_MARK, ANY_MARK = r"(?i)\[E\s*([0-9]+)\]", r"\[([0-9]+)\]", r"(?i)\[(?:E\s*)?[0-9]+\]"
REASONS = ["edge_not_in_subgraph", "no_edge_cited", "chunk_not_edge_source", "chunk_does_not_name_endpoints", "uncovered_entity"]
#: What stands for a name that has been found: a letter or a mark, as the name's own first and last characters are.
LETTER, MARK = "ˑ", "\x02"


def numbers(text: Column, pattern: str) -> Column:
    """Distinct numbers in marks, in order. Numbers of more than nine digits are in no list and count as 0."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.when(F.length(F.ltrim(n, F.lit("0"))) <= 9, F.coalesce(n.cast("int"), F.lit(0))).otherwise(0)))


def named(text: Column, names: Column) -> Column:
    """Which of the names (array of keys) a text has, given as its key: whole words or phrases, the longest first, which take their place in the text, so that a name
    inside a longer one isn't met there. Patterns are made of those names alone that the text has anywhere."""
    stand_in = lambda c: F.when(F.rlike(c, F.lit(r"(?U)\w")), F.lit(LETTER)).otherwise(F.lit(MARK))

    def step(state: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))
        ends = F.concat(stand_in(F.substring(name, 1, 1)), stand_in(F.substring(name, -1, 1)))
        met = F.contains(state["left"], name) & F.rlike(state["left"], pattern)
        return F.when(met, F.struct(F.regexp_replace(state["left"], pattern, ends).alias("left"), F.concat(state["found"], F.array(name)).alias("found"))).otherwise(state)

    sized = F.transform(F.filter(F.array_distinct(names), lambda n: n != ""), lambda n: F.struct((-F.length(n)).alias("size"), n.alias("name")))
    longest_first = F.transform(F.array_sort(sized), lambda x: x["name"])
    start = F.struct(text.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(longest_first, start, step)["found"]


def mentions(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """The claims' (walk_id, claim_id, text) own columns, names (keys), node_ids of the nodes (walk_id, node_id, name) that each names, and `of` (key, node_id of these). A
    walk's nodes are as many as its budget."""
    keyed = nodes.select("walk_id", "node_id", name_key(F.col("name")).alias("key")).where("key <> ''")
    listed = keyed.groupBy("walk_id").agg(F.collect_set("key").alias("keys"), F.collect_list(F.struct("key", "node_id")).alias("of"))
    bare = name_key(F.regexp_replace(F.coalesce("text", F.lit("")), ANY_MARK, " "))
    rows = claims.withColumn("bare", bare).join(listed, "walk_id", "left").withColumn("names", F.when(F.col("keys").isNotNull(), named(F.col("bare"), F.col("keys"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select(*claims.columns, "names", F.filter("of", lambda x: F.array_contains("names", x["key"])).alias("of"))
    ids = F.transform("of", lambda x: x["node_id"])
    return rows.withColumn("node_ids", F.coalesce(F.array_distinct(ids), F.array().cast(ids_type(nodes))))


def ids_type(nodes: DataFrame) -> str:
    return f"array<{nodes.schema['node_id'].dataType.simpleString()}>"


def judged(claims: DataFrame, nodes: DataFrame, edges: DataFrame, passages: DataFrame) -> DataFrame:
    """walk_id, claim_id, is_relation and reason: why a claim about relations goes, null if it stays or isn't one.

    claims (walk_id, claim_id, text), nodes (walk_id, node_id, name), edges (walk_id, k, src, dst, chunk_ids), passages (walk_id, n, chunk_id, text). A claim is about relations if
    it names two nodes of different names or has an edge mark `[E k]`. In this order: every edge mark is an edge of the walk; a cited edge joins two
    named nodes; each such edge has a cited passage `[n]` among its sources; one of those names both its ends; every named node is an end of
    such an edge, for a name of two nodes one of them. Direction and wording aren't judged.
    """
    rows = mentions(claims.select("walk_id", "claim_id", "text"), nodes)
    rows = cut(rows.select("walk_id", "claim_id", numbers(F.col("text"), EDGE_MARK).alias("ks"), numbers(F.col("text"), PASSAGE_MARK).alias("ns"), "names", "node_ids", "of"))  # made once for both that are made of them
    cited = rows.select("walk_id", "claim_id", "node_ids", "ns", F.explode("ks").alias("k")).join(edges.select("walk_id", "k", "src", "dst", "chunk_ids", F.lit(True).alias("known")), ["walk_id", "k"], "left")
    joins = F.col("known") & F.array_contains("node_ids", F.col("src")) & F.array_contains("node_ids", F.col("dst"))
    cited = cited.withColumn("joins", F.coalesce(joins, F.lit(False)))
    ends = nodes.select("walk_id", "node_id", name_key(F.col("name")).alias("key"))
    first, second = (ends.select("walk_id", F.col("node_id").alias(e), F.col("key").alias(f"{e}_key")) for e in ("src", "dst"))
    read = cited.where("joins").select("walk_id", "claim_id", "k", "src", "dst", "chunk_ids", F.explode("ns").alias("n")).join(passages.select("walk_id", "n", "chunk_id", "text"), ["walk_id", "n"]).where(F.array_contains("chunk_ids", F.col("chunk_id")))
    read = read.join(first, ["walk_id", "src"]).join(second, ["walk_id", "dst"]).withColumn("said", name_key(F.regexp_replace("text", ANY_MARK, " ")))
    both = F.array("src_key", "dst_key")
    tells = (F.col("src_key") != "") & (F.col("dst_key") != "") & (F.size(named(F.col("said"), both)) == F.size(F.array_distinct(both)))
    backed = read.groupBy("walk_id", "claim_id", "k").agg(F.max(tells).alias("tells"))
    by_edge = cited.join(backed, ["walk_id", "claim_id", "k"], "left")
    by_claim = by_edge.groupBy("walk_id", "claim_id").agg(
        F.max(F.col("known").isNull()).alias("unknown"),
        F.max("joins").alias("any_joins"),
        F.max(F.col("joins") & F.col("tells").isNull()).alias("unsourced"),
        F.max(F.col("joins") & ~F.coalesce("tells", F.lit(True))).alias("unnamed"),
        F.flatten(F.collect_set(F.when(F.col("joins"), F.array("src", "dst")))).alias("covered"),
    )
    rows = rows.join(by_claim, ["walk_id", "claim_id"], "left")
    is_relation = (F.size("ks") > 0) | (F.size("names") > 1)
    bare = F.exists("names", lambda n: ~F.exists("of", lambda x: (x["key"] == n) & F.array_contains("covered", x["node_id"])))
    reason = F.when(F.coalesce("unknown", F.lit(False)), REASONS[0]).when(~F.coalesce("any_joins", F.lit(False)), REASONS[1]).when(F.col("unsourced"), REASONS[2]).when(F.col("unnamed"), REASONS[3]).when(bare, REASONS[4])
    return rows.select("walk_id", "claim_id", is_relation.alias("is_relation"), F.when(is_relation, reason).alias("reason"))
