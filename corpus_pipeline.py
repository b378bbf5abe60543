"""A training corpus from documents in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, similar, substrings, toxicity
from siftwell.llm.bitmap import decided, without
from siftwell.llm.shared import scratch, shared_dir, spare, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is one half or more. Without labels of both kinds, all stay.

    Null and empty texts are scored as a text without words; repeated rows are judged alike; other columns stay as they are.
    """
    net, own = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), spare("toxicity", docs)
    return toxicity.score(docs, net, own).where(F.col(own) < 0.5).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest doc_id (a null is the last), and of several
    texts under that id the one whose row has the least name. Of repeated rows of that document one stays.

    Documents without words, null texts too, are linked with nothing and all stay.
    """
    found = similar.similar_documents(docs, count_links=False).where("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    groups = found.groupBy("root").agg(F.min(order)["uid"].alias("first"), F.count("*").alias("n")).where("n > 1")
    return decided(docs, found.join(groups, "root").select("doc_id", "uid", (F.col("uid") == F.col("first")).alias("keep")))


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are the words left, joined by one space, maybe none; all others stay as they are, nulls as empty.

    Every row stays, repeated ones too, and other columns as they are, but for n_chars, which is that of the text.
    """
    found = substrings.deduplicate(docs, original=True)
    columns = [F.col("kept").alias("text") if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"others.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark windows in a twentieth of their words or more. Texts without words are clean;
    repeated rows are judged alike; other columns stay as they are."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids of each row's text (null: empty), and the digest of what they decode to."""
    found = bpe.round_trip(docs)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: A trained network and rounds of components are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. What a stage keeps on the way is deleted when its output is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
    return docs
