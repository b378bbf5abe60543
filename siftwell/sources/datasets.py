"""Public question sets as tables: documents (source_id, text), questions (question_id, question, expected), sources
(question_id, document, evidence), and what was dropped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import flat

#: Characters of evidence that have to occur in an article.
EVIDENCE = 72


def beir(spark: SparkSession, folder: str, split: str = "test") -> dict[str, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv: judgements of zero or less, and those without document or query, are
    dropped and counted."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("query string, document string, score int").csv(f"{folder}/qrels/{split}.tsv")
    docs = corpus.select(F.col("_id").alias("source_id"), F.concat_ws("\n\n", F.when(F.trim("title") != "", F.col("title")), "text").alias("text"))
    known = qrels.join(docs.select(F.col("source_id").alias("document"), F.lit(True).alias("d")), "document", "left").join(queries.select(F.col("_id").alias("query"), F.lit(True).alias("q")), "query", "left")
    fate = F.when(F.col("score") <= 0, "score").when(F.col("d").isNull(), "document").when(F.col("q").isNull(), "query").otherwise("kept")
    judged = known.withColumn("fate", fate)
    kept = judged.where("fate = 'kept'").select(F.col("query").alias("question_id"), "document", F.lit(None).cast("string").alias("evidence")).distinct()
    asked = queries.join(kept.select(F.col("question_id").alias("_id")), "_id", "left_semi").select(F.col("_id").alias("question_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("expected"))
    return {"documents": docs, "questions": asked, "sources": kept, "dropped": judged.where("fate <> 'kept'").groupBy("fate").agg(F.count("*").alias("n"))}


def slug(title):
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def multihop(spark: SparkSession, corpus: str, questions: str) -> dict[str, DataFrame]:
    """Articles named by their title's slug (later ones of a name get -2, -3 by url), and questions whose every piece of evidence
    begins, flattened, in its article; others are dropped and counted."""
    articles = spark.read.option("multiLine", True).schema("title string, url string, body string").json(corpus).where("url IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("url"))
    articles = articles.withColumn("name", slug(F.col("title"))).withColumn("k", nth)
    articles = articles.select("url", "body", F.when(F.col("k") > 1, F.concat_ws("-", "name", "k")).otherwise(F.col("name")).alias("source_id"))
    kind = "query string, answer string, question_type string, evidence_list array<struct<url:string,fact:string>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(questions).withColumn("question_id", F.sha2("query", 256))
    each = rows.select("question_id", F.explode("evidence_list").alias("e")).select("question_id", "e.url", F.substring("e.fact", 1, EVIDENCE).alias("evidence"))
    met = each.join(articles, "url", "left").withColumn("found", F.coalesce(F.contains(flat(F.col("body")), flat(F.col("evidence"))), F.lit(False)))
    good = met.groupBy("question_id").agg(F.bool_and("found").alias("ok"))
    judged = rows.join(good, "question_id", "left").withColumn("fate", F.when(F.col("ok").isNull(), "no_evidence").when(F.col("ok"), "kept").otherwise("not_found"))
    asked = judged.where("fate = 'kept'").select("question_id", F.col("query").alias("question"), F.col("answer").alias("expected"))
    sources = met.join(asked.select("question_id"), "question_id", "left_semi").select("question_id", F.col("source_id").alias("document"), "evidence").distinct()
    return {"documents": articles.select("source_id", F.col("body").alias("text")), "questions": asked, "sources": sources, "dropped": judged.where("fate <> 'kept'").groupBy("fate").agg(F.count("*").alias("n"))}


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a set, one row each with its sources; an id that occurs twice is an error."""
    source = "struct<document:string,evidence:string>"
    kind = f"questions array<struct<id:string,question:string,expected_answer:string,expected_sources:array<{source}>,question_type:string,difficulty:string>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path).select(F.explode("questions").alias("q")).select("q.*")
    twice = [r.id for r in rows.groupBy("id").count().where("count > 1").orderBy("id").limit(10).collect()]
    if twice:
        raise ValueError(f"ids occur twice: {', '.join(map(str, twice))}")
    return rows


def export_prompts(questions: DataFrame, hits: DataFrame, texts: DataFrame, path: str) -> None:
    """JSON lines, one a question: id, question, and its passages in order of rank with their texts."""
    passages = texts.select("doc_id", "text").join(hits, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("number"), F.col("doc_id").alias("chunk_id"), "text", "score"))).alias("passages"))
    questions.join(passages, "query_id", "left").select(F.col("query_id").alias("id"), "question", F.coalesce("passages", F.array()).alias("passages")).write.mode("overwrite").json(path)


def import_answers(lines: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """Answers of JSON lines (column `value`) that name an asked question once, and counts of errors: unreadable_line,
    invalid_record (no id or answer), unknown_id, duplicate_id (all copies are void), missing_answer."""
    record = F.from_json("value", "id long, answer string, model string, input_tokens long, output_tokens long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("value", record.alias("r"))
    parsed = rows.select("r.*", (F.col("r").isNull() | F.col("r._bad").isNotNull()).alias("bad"))
    asked = questions.select(F.col("query_id").alias("id"), F.lit(True).alias("asked"))
    valid = parsed.where("NOT bad AND id IS NOT NULL AND answer IS NOT NULL").join(asked, "id", "left")
    counts = valid.groupBy("id").agg(F.count("*").alias("copies"))
    valid = valid.join(counts, "id").withColumn("kind", F.when(F.col("asked").isNull(), "unknown_id").when(F.col("copies") > 1, "duplicate_id").otherwise("ok"))
    answers = valid.where("kind = 'ok'").select("id", "answer", "model", "input_tokens", "output_tokens")
    wrong = parsed.where("bad OR id IS NULL OR answer IS NULL").select(F.when(F.col("bad"), "unreadable_line").otherwise("invalid_record").alias("kind"))
    missing = asked.join(counts, "id", "left_anti").select(F.lit("missing_answer").alias("kind"))
    errors = valid.where("kind <> 'ok'").select("kind").unionByName(wrong).unionByName(missing)
    return {"answers": answers, "errors": errors.groupBy("kind").agg(F.count("*").alias("n"))}
