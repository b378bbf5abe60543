"""Which texts hold which of a set of passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranking import hint

#: Passages of one or two words that are looked for in one pass over the texts.
BLOCK = 500


def words(text):
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def passages(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """item_id, doc_id where the document's text holds the passage, for docs (doc_id, text) and items (item_id, passage).

    A passage's inner words are whole words of every text that holds it, so it is filed under the rarest of them, and only texts with that word are compared with
    it. Passages without inner words are a stated set that goes over all texts, `block` of them at a time. Nulls hold nothing and are held nowhere; an empty passage is in every
    text. A row of either table that repeats counts again.
    """
    items = items.where(F.col("passage").isNotNull()).withColumn("inner", words(F.array_join(F.expr("slice(split(passage, ' '), 2, greatest(0, size(split(passage, ' ')) - 2))"), " ")))
    long = items.where(F.size("inner") > 0)
    sized = hint(long.select("item_id"))
    wanted = sized(long.select(F.explode("inner").alias("word")).distinct())
    each = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    counts = each.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    filed = long.select("item_id", "passage", F.explode("inner").alias("word")).join(sized(counts), "word", "left").groupBy("item_id", "passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("by"))
    filed = long.select("item_id", "passage").join(filed.select("item_id", "passage", "by"), ["item_id", "passage"]).where("by.n > 0").select("item_id", "passage", "by.word")
    met = each.join(sized(filed.select("word", "item_id", "passage")), "word").select("doc_id", "item_id", "passage").distinct()
    found = [long.select("item_id", "passage").join(met.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "passage", "doc_id"), ["item_id", "passage"]).select("item_id", "doc_id")]
    short = items.where(F.size("inner") == 0)
    n = short.count()
    for b in range(-(-n // block)):
        part = short if n <= block else short.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(-(-n // block))) == b)
        rows = [(r.item_id, r.passage) for r in part.select("item_id", "passage").collect()]  # about `block` short texts
        if rows:
            own = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(p).alias("passage")) for i, p in rows])
            found.append(docs.select("doc_id", F.explode(F.filter(own, lambda x: F.contains("text", x["passage"]))).alias("x")).select("x.item_id", "doc_id"))
    return reduce(DataFrame.unionByName, [f.select(F.col("item_id").cast("long").alias("item_id"), F.col("doc_id").cast("long").alias("doc_id")) for f in found])
