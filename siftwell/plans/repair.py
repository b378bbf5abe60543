"""Queries of repair moves over users' turns, and numbered edge lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import repair as R
from siftwell.plans.registry import query, table


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Users' turns as questions of several shapes; both the plan and the SQL state the rule.
_ASKED = """q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || ' and the exact reason for that' WHEN 1 THEN 'Exactly ' || text || ' in production' WHEN 2 THEN text || ' vs ' || role || ' text here' ELSE text END AS q
  FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_WORDS = r"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"
_SPLIT = f"list_filter(list_transform(string_split_regex(q, '(?i){{s}}'), lambda p: {_STRIP.format(x='p')}), lambda p: p <> '')"
_PARTS = (
    "coalesce(" + ", ".join(f"CASE WHEN len({p}) > 1 AND len(list_filter({p}, lambda x: len({_WORDS.format(x='x')}) < {R.PART_WORDS})) = 0 THEN {p} END" for p in (_SPLIT.format(s=s) for s in R.SPLITTERS)) + f", [{_STRIP.format(x='q')}])"
)


def _asked(spark, sf_dir):
    text, shape = F.col("text"), F.col("turn") % 4
    q = F.when(shape == 0, F.concat(text, F.lit(" and the exact reason for that"))).when(shape == 1, F.concat(F.lit("Exactly "), text, F.lit(" in production")))
    q = q.when(shape == 2, F.concat(text, F.lit(" vs "), "role", F.lit(" text here"))).otherwise(text)
    return table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", q.alias("q"))


@query(
    "st06_repaired_questions",
    f"""WITH {_ASKED}, b AS (SELECT *, array_to_string(list_filter({_WORDS.format(x='q')}, lambda w: NOT list_contains({_sql_list(R.QUALIFIERS)}, trim(lower(w), ','))), ' ') AS plain,
      array_to_string(list_filter({_WORDS.format(x='q')}, lambda w: NOT list_contains({_sql_list(R.STOPWORDS)}, lower(w))), ' ') AS content, 'turn ' || turn AS missing FROM q),
    c AS (SELECT *, trim(regexp_replace(plain, '(?i) ({'|'.join(R.PREPOSITIONS)}) .*$', '')) AS cut FROM b)
    SELECT conv_id, turn, CASE WHEN cut <> '' AND cut <> q THEN cut WHEN content <> '' THEN content ELSE q END AS broadened, CASE WHEN contains(lower(q), lower(missing)) THEN q ELSE q || ' ' || missing END AS narrowed,
      array_to_string({_PARTS}, ' | ') AS parts, least(100, greatest(turn * 2, turn + 5)) AS wider, least(turn, 5) AS narrower FROM c""",
)
def repaired_questions(spark, sf_dir):
    q, turn = F.col("q"), F.col("turn")
    missing = F.concat(F.lit("turn "), turn.cast("string"))
    return _asked(spark, sf_dir).select(
        "conv_id", "turn", R.broadened(q).alias("broadened"), R.narrowed(q, missing).alias("narrowed"), F.array_join(R.parts(q), " | ").alias("parts"), R.wider(turn).alias("wider"), R.narrower(turn).alias("narrower")
    )


_USABLE = "NOT list_contains(tried, {m}) AND ({m} <> 'decompose' OR compound) AND ({m} <> 'fetch_document' OR has_document)"


@query(
    "st06_next_move",
    f"""WITH {_ASKED}, a AS (SELECT *, conv_id % 2 = 0 AS has_evidence, conv_id % 3 = 0 AS has_document, CASE conv_id % 5 WHEN 0 THEN 'abandon' WHEN 1 THEN 'decompose' END AS proposed, len({_PARTS}) > 1 AS compound FROM q),
    o AS (SELECT *, CASE WHEN has_evidence THEN {_sql_list(R.OFF_POINT)} ELSE {_sql_list(R.NOTHING_FOUND)} END AS moves FROM a), t AS (SELECT *, moves[1:(turn % 6)] AS tried FROM o)
    SELECT conv_id, turn, CASE WHEN proposed = 'abandon' AND len(tried) > 0 THEN 'abandon' WHEN proposed <> 'abandon' AND {_USABLE.format(m='proposed')} THEN proposed
      ELSE coalesce(list_filter(moves, lambda m: {_USABLE.format(m='m')})[1], 'abandon') END AS move FROM t""",
)
def next_move(spark, sf_dir):
    conv, evidence = F.col("conv_id"), F.col("conv_id") % 2 == 0
    order = F.when(evidence, F.array(*map(F.lit, R.OFF_POINT))).otherwise(F.array(*map(F.lit, R.NOTHING_FOUND)))
    tried = F.slice(order, F.lit(1), (F.col("turn") % 6).cast("int"))
    proposed = F.when(conv % 5 == 0, "abandon").when(conv % 5 == 1, "decompose")
    return _asked(spark, sf_dir).select("conv_id", "turn", R.next_move(proposed, tried, evidence, conv % 3 == 0, F.size(R.parts(F.col("q"))) > 1).alias("move"))


@query(
    "gr17_edge_list",
    """WITH e AS (SELECT n_nationkey AS walk_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS k, c_custkey, c_name, n_name, c_custkey % 2 = 0 AS reversed FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT c_nationkey AS walk_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
    s AS (SELECT c_custkey, string_agg('[' || n || ']', ', ' ORDER BY n) AS marks FROM p GROUP BY c_custkey)
    SELECT walk_id, k, '[E ' || k || '] ' || CASE WHEN reversed THEN n_name || ' HOLDS ' || c_name ELSE c_name || ' LOCATED_IN ' || n_name END || ' (source passages: ' || coalesce(marks, 'none provided') || ')' AS line FROM e LEFT JOIN s USING (c_custkey)""",
)
def edge_list(spark, sf_dir):
    """Customers of a nation as the edges of a walk, all their orders as sources, the nation's finished orders as passages."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("walk_id"), F.col("n_name").alias("target_name"))
    nth = lambda order: F.row_number().over(Window.partitionBy("walk_id").orderBy(order)).cast("long")
    back = F.col("c_custkey") % 2 == 0
    of = customers.select("c_custkey", F.col("c_nationkey").alias("walk_id"), F.col("c_name").alias("source_name"))
    edges = of.join(nations, "walk_id").select("walk_id", nth("c_custkey").alias("k"), F.col("c_custkey").alias("edge_id"), "source_name", "target_name", F.when(back, "HOLDS").otherwise("LOCATED_IN").alias("walked_as"), back.alias("reversed"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    sources = orders.select(F.col("c_custkey").alias("edge_id"), F.col("o_orderkey").alias("chunk_id"))
    passages = orders.where("o_orderstatus = 'F'").join(of, "c_custkey").select("walk_id", nth("o_orderkey").alias("n"), F.col("o_orderkey").alias("chunk_id"))
    return R.edge_lines(edges, sources, passages)
