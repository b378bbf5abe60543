"""A small corpus out of a question set: some questions with all their relevant documents, and other documents beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftwell.operators.lineage import cut


def drawn(ident: str, seed: int) -> Column:
    """A place in an order that a seed gives, the same whatever the partitions."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), F.col(ident))


def taken_questions(relevant: DataFrame, budget: int | None, most: int | None, seed: int) -> DataFrame:
    """query_id of the questions (relevant: query_id, doc_id) that are taken one after the other in the seed's order, each if the union of the documents of all that are taken stays
    within the budget; at most `most`.

    A round takes all questions before the first that doesn't fit, by a running sum of what each adds to the union. Then what no longer fits by itself
    goes, so the next round takes at least one. A round looks at as many questions as could fit and no more, nearest first.
    """
    pairs = cut(relevant.select("query_id", "doc_id").where("query_id IS NOT NULL").distinct())
    left = cut(pairs.select("query_id", drawn("query_id", seed).alias("place")).distinct())
    if budget is None:
        out = left.orderBy("place")
        return (out if most is None else out.limit(most)).select("query_id")
    taken, union = left.select("query_id").limit(0), pairs.select("doc_id").limit(0)
    n, room = 0, budget
    while most is None or n < most:
        adds = pairs.where("doc_id IS NOT NULL").join(union, "doc_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("adds"))
        fits = cut(left.join(adds, "query_id", "left").withColumn("adds", F.coalesce("adds", F.lit(0))).where(F.col("adds") <= room))
        if fits.isEmpty():
            break
        # every question that adds something takes a place, so one more than the room are enough
        some = fits.where("adds > 0").orderBy("place").limit(room + 1)
        last = some.agg(F.max("place").alias("last"), F.count("*").alias("n")).first()
        near = fits if last.n <= room else fits.join(some.select("query_id"), "query_id", "left_semi").unionByName(fits.where("adds = 0").join(some.agg(F.max("place").alias("last")), F.col("place") < F.col("last")).drop("last"))
        fresh = pairs.join(near.select("query_id", "place"), "query_id").where("doc_id IS NOT NULL").join(union, "doc_id", "left_anti")
        new = fresh.groupBy("doc_id").agg(F.min_by("query_id", "place").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("new"))
        running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        sums = cut(near.where("adds > 0").join(new, "query_id", "left").select("query_id", "place", F.sum(F.coalesce("new", F.lit(0))).over(running).alias("so_far")))
        over = sums.where(F.col("so_far") > room).agg(F.min("place").alias("at"))
        free = near.where("adds = 0").select("query_id", "place")
        own = sums.where(F.col("so_far") <= room).select("query_id", "place").unionByName(free).join(over, F.col("at").isNull() | (F.col("place") < F.col("at"))).select("query_id", "place")
        got = cut(own if most is None else own.orderBy("place").limit(most - n))
        taken = cut(taken.unionByName(got.select("query_id")))
        union = cut(pairs.where("doc_id IS NOT NULL").join(taken, "query_id", "left_semi").select("doc_id").distinct())
        n, room = taken.count(), budget - union.count()
        passed = cut(over.where("at IS NOT NULL"))
        left = left.join(got.select("query_id"), "query_id", "left_anti")
        left = cut(left.join(passed, F.col("place") != F.col("at"), "left_semi") if not passed.isEmpty() else left)
    return taken


def sample_corpus(relevant: DataFrame, documents: DataFrame, limit: int | None, questions: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """query_id of the questions and doc_id of the documents of a sample: relevant documents fill half of the limit at most, documents that the seed draws the rest. Without a limit, all
    documents. The same sample for the same seed and rows, however they are partitioned."""
    taken = cut(taken_questions(relevant, None if limit is None else limit // 2, questions, seed))
    every = documents.select("doc_id").where("doc_id IS NOT NULL").distinct()
    if limit is None:
        return taken, every
    needed = cut(relevant.join(taken, "query_id", "left_semi").select("doc_id").where("doc_id IS NOT NULL").distinct())
    room = max(0, limit - needed.count())
    return taken, needed.unionByName(every.join(needed, "doc_id", "left_anti").orderBy(drawn("doc_id", seed)).limit(room))
