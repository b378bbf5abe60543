"""Measures of retrieval and answers. What can't be measured stays null; means are over what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import eval_words

# What marks a refusal, and the share of supported words a sentence needs.
NO_EVIDENCE = "could not find"
SUPPORT = 0.5


def retrieval_scores(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """precision, recall, hit and reciprocal_rank per query of `sources` (query_id, item), from hits (query_id, rank, item).

    Precision is null where nothing was returned. Queries without sources aren't in the result: nothing can be measured.
    """
    marked = hits.join(sources.withColumn("relevant", F.lit(1)), ["query_id", "item"], "left")
    return scores_of(marked, sources.groupBy("query_id").agg(F.count("*").alias("wanted")))


def scores_of_labels(hits: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """As `retrieval_scores` where the sources of a query (query_id, label) are the other items (item, label) of its label: hits (query_id, rank, item) are compared by label, and sources
    are counted by label, so that no pairs of queries and sources are written out. Queries are items too and not their own source; those of a null label have none."""
    sizes = items.where("label IS NOT NULL").groupBy("label").agg((F.count("*") - 1).alias("wanted")).where("wanted > 0")
    marked = hits.join(queries.select("query_id", F.col("label").alias("own")), "query_id").join(items.select("item", "label"), "item").where("item <> query_id")
    return scores_of(marked.withColumn("relevant", F.when(F.col("own") == F.col("label"), 1)), queries.join(sizes, "label").select("query_id", "wanted"))


def scores_of(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """The measures from hits that are marked (query_id, rank, item, relevant: 1 or null) and the number of sources of each query (query_id, wanted)."""
    per = marked.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("relevant").alias("found"), F.countDistinct(F.when(F.col("relevant") == 1, F.col("item"))).alias("covered"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    rows = wanted.join(per, "query_id", "left")
    return rows.select(
        "query_id", F.round(F.try_divide("found", "returned"), 6).alias("precision"), F.round(F.coalesce("covered", F.lit(0)) / F.col("wanted"), 6).alias("recall"),
        (F.coalesce("found", F.lit(0)) > 0).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct words; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(2 * both / (F.size(a) + F.size(b)), 6))


def lexical_judgement(answers: DataFrame) -> DataFrame:
    """correctness (F1 of content words of answer and expected) and context_relevance (the context shares a word with what is
    expected) for rows of id columns, expected, answer and context."""
    e, a, c = (eval_words(F.col(n)) for n in ("expected", "answer", "context"))
    return answers.select("*", word_f1(a, e).alias("correctness"), F.when((F.size(e) > 0) & F.col("context").isNotNull(), F.arrays_overlap(c, e).cast("double")).alias("context_relevance"))


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(NO_EVIDENCE))


def markers(answer: Column) -> Column:
    """Cited numbers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)))


def contract_violation(answer: Column, contexts: Column) -> Column:
    """What an answer breaks: a marker without passage, no citation though there is evidence, a quote that no cited passage
    has (of eight characters or more, or with a digit), or no words; null if nothing."""
    cited = F.transform(markers(answer), lambda m: m.cast("int"))
    flat = lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    quotes = F.filter(F.regexp_extract_all(answer, F.lit('"([^"]+)"'), F.lit(1)), lambda q: (F.length(q) >= 8) | q.rlike("[0-9]"))
    within = F.transform(F.filter(cited, lambda m: (m >= 1) & (m <= F.size(contexts))), lambda m: flat(F.element_at(contexts, m)))
    return (
        F.when(F.exists(cited, lambda m: (m < 1) | (m > F.size(contexts))), "marker_out_of_range")
        .when((F.size(contexts) > 0) & (F.size(cited) == 0) & ~is_refusal(answer), "uncited")
        .when(F.exists(quotes, lambda q: ~F.exists(within, lambda t: F.contains(t, flat(q)))), "quote_not_found")
        .when(~F.regexp_replace(answer, r"\[\d+\]", "").rlike("[A-Za-z0-9]"), "no_words")
    )
