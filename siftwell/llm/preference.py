"""Preference formatting: one prompt for a chosen and a rejected conversation, and a masked completion for each.

The longest common prefix of turns (equal role and text, in order of turn) is rendered once as the prompt. What follows
it in each conversation is that side's completion, with a mask over its characters. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The role whose words a model is trained on.
TRAINED = "assistant"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """The turns as one string; null roles and texts as empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), body(t["text"]))), "")


def mask(turns: Column) -> Column:
    """Runs of `render(turns)` as "flag*characters", separated by spaces: 1 for the words and end mark of trained turns."""
    flag = lambda t: F.when(t["role"] == TRAINED, "1*").otherwise("0*")
    size = lambda c: F.length(c).cast("string")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("0*"), size(head(t["role"])), F.lit(" "), flag(t), size(body(t["text"])))), " ")


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def preferences(turns: DataFrame) -> DataFrame:
    """pair_id, prompt, n_prompt_turns, and chosen, rejected and their masks, from turns with pair_id and is_chosen.

    Turns are ordered by turn, then role and text, nulls first, so repeated turns have a fixed order. A side without
    turns has an empty completion and an empty mask, and the prompt is then empty. Turns without pair_id are left out: they
    belong to no pair. A conversation has to fit in a row; a pair's turns are all that is ever collected together.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("is_chosen") == flag, turn)))
    pairs = turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    pairs = pairs.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.slice("a", 1, F.col("n"))).alias("prompt"),
        *[x for name, c in (("chosen", "a"), ("rejected", "b")) for x in (render(rest(c)).alias(name), mask(rest(c)).alias(f"{name}_mask"))],
    )


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences, so conversations 2n and 2n + 1 are pair n, the even one chosen."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return preferences(rows.select("turn", "role", "text", pair.alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen")))


ORACLE_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), matched AS (
  SELECT a.pair_id, a.pos FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side <> 0
    AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
), prefix AS (
  SELECT p.pair_id, coalesce(max(m.run), 0) AS n FROM (SELECT DISTINCT pair_id FROM t) p
  LEFT JOIN (SELECT pair_id, pos AS run FROM (
    SELECT pair_id, pos, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS k FROM matched) WHERE pos = k) m
  ON m.pair_id = p.pair_id GROUP BY p.pair_id
), r AS (
  SELECT t.pair_id, side, pos, pos <= n AS in_prompt, n,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown,
    '0*' || (length(coalesce(role, '')) + 5) || CASE WHEN role = 'assistant' THEN ' 1*' ELSE ' 0*' END || (length(coalesce(text, '')) + 8) AS runs
  FROM t JOIN prefix USING (pair_id)
)
SELECT pair_id, CAST(max(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE in_prompt AND side = 0), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT in_prompt AND side = 0), '') AS chosen,
  coalesce(string_agg(runs, ' ' ORDER BY pos) FILTER (WHERE NOT in_prompt AND side = 0), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT in_prompt AND side <> 0), '') AS rejected,
  coalesce(string_agg(runs, ' ' ORDER BY pos) FILTER (WHERE NOT in_prompt AND side <> 0), '') AS rejected_mask
FROM r GROUP BY pair_id
"""
