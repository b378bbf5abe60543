"""Queries of mentions and samples: parts' names as mentions of parts, customers' orders as questions with relevant parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators.mentions import match_mentions
from siftwell.plans.registry import query, table
from siftwell.sources.sampler import sample_corpus

_SHAPE = "(p_partkey // 20) % 6"


@query(
    "gr12_mention_ladder",
    rf"""WITH sp AS (SELECT CAST(p_partkey AS BIGINT) AS entity_id, p_brand AS type, lower(p_name) AS s, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: w[1]), 'string_agg', '') AS ini FROM part),
    m AS (SELECT CAST(p_partkey AS BIGINT) AS mention_id, CASE WHEN {_SHAPE} = 1 THEN 'nobody' ELSE p_brand END AS want, CASE {_SHAPE} WHEN 2 THEN 'The ' || p_name || '.' WHEN 3 THEN 'our new ' || p_name || ' for teams' WHEN 4 THEN split_part(p_name, ' ', 2) WHEN 5 THEN upper(p_name[1] || split_part(p_name, ' ', 2)[1]) ELSE p_name END AS name FROM part WHERE p_partkey % 20 = 0),
    k AS (SELECT *, regexp_replace(lower(name), '[.]$', '') AS key, regexp_replace(regexp_replace(lower(name), '[.]$', ''), '^(the|our) ', '') AS core FROM m),
    f AS (SELECT mention_id, entity_id, min(CASE WHEN key = s AND want = type THEN 1 WHEN key = s THEN 2 WHEN core = s THEN 3 WHEN length(core) >= 3 AND (contains(' ' || core || ' ', ' ' || s || ' ') OR contains(' ' || s || ' ', ' ' || core || ' ')) THEN 4 ELSE 5 END) AS step
      FROM k JOIN sp ON key = s OR (length(core) >= 3 AND (contains(' ' || core || ' ', ' ' || s || ' ') OR contains(' ' || s || ' ', ' ' || core || ' '))) OR (regexp_matches(name, '^[A-Z]{{2,6}}$') AND ini = lower(name)) GROUP BY 1, 2)
    SELECT mention_id, entity_id, step FROM f QUALIFY step = min(step) OVER (PARTITION BY mention_id)""",
)
def mention_ladder(spark, sf_dir):
    """Parts with an id divisible by 20 as mentions of several shapes, against the names of all parts. Initials in capitals count whatever they spell, as OR does for an old rod."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name", "p_brand")
    shape, second = F.floor(F.col("id") / 20) % 6, F.split("p_name", " ")[1]
    name = F.when(shape == 2, F.concat(F.lit("The "), "p_name", F.lit("."))).when(shape == 3, F.concat(F.lit("our new "), "p_name", F.lit(" for teams"))).when(shape == 4, second)
    name = name.when(shape == 5, F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(second, 1, 1)))).otherwise(F.col("p_name"))
    mentions = parts.where("id % 20 = 0").select(F.col("id").alias("mention_id"), name.alias("name"), F.when(shape == 1, "nobody").otherwise(F.col("p_brand")).alias("entity_type"))
    return match_mentions(mentions, parts.select(F.col("id").alias("entity_id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("surface_name")), capitals=True)


_LIMIT, _SEED = 1000, 7
_TAKEN = f"""RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY md5('{_SEED}:' || q), q) AS i FROM (SELECT CAST(o_custkey AS BIGINT) AS q, list(DISTINCT CAST(l_partkey AS BIGINT)) AS ds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)),
 g(i, docs, hit) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false UNION ALL SELECT p.i, CASE WHEN len(list_distinct(list_concat(docs, ds))) <= {_LIMIT // 2} THEN list_distinct(list_concat(docs, ds)) ELSE docs END, len(list_distinct(list_concat(docs, ds))) <= {_LIMIT // 2} FROM g JOIN p ON p.i = g.i + 1)"""


def _sample(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    relevant = pairs.select(F.col("o_custkey").cast("long").alias("query_id"), F.col("l_partkey").cast("long").alias("doc_id"))
    return sample_corpus(relevant, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id")), _LIMIT, seed=_SEED)


@query("src16_sampled_questions", f"WITH {_TAKEN} SELECT q AS query_id FROM p JOIN g USING (i) WHERE hit")
def sampled_questions(spark, sf_dir):
    return _sample(spark, sf_dir)[0]


@query(
    "src16_sampled_documents",
    f"""WITH {_TAKEN}, ne AS (SELECT docs FROM g ORDER BY i DESC LIMIT 1), un AS (SELECT unnest(docs) AS doc_id FROM ne)
    SELECT doc_id FROM un UNION ALL (SELECT CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM un) ORDER BY md5('{_SEED}:' || p_partkey), p_partkey LIMIT greatest(0, {_LIMIT} - (SELECT len(docs) FROM ne)))""",
)
def sampled_documents(spark, sf_dir):
    return _sample(spark, sf_dir)[1]
