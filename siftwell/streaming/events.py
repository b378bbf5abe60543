"""Streams of events: rate limits by window, and corpora that are indexed as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions.text import tokens
from siftwell.operators.limits import limited
from siftwell.operators.lineage import files_of


def limited_stream(events: DataFrame, subject: str, ts: str, limit: int, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """As `limited`; rows later than the watermark are dropped and state of closed windows is freed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return limited(timed.withWatermark(ts, late), subject, ts, limit, every)


def once(events: DataFrame, ident: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Term deltas (term, df) of documents that arrive as Parquet files, one folder a batch: a batch that runs again replaces its
    own folder, so the sums over folders count every document once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        terms = batch.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        terms.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, target: str) -> DataFrame:
    """Sums over the folders of batches whose write has ended; none before the first."""
    where, files = files_of(spark, f"{target}/batch=*/_SUCCESS")
    done = [f.getPath().getParent().toString() for f in files.globStatus(where) or []]
    found = spark.read.schema("term string, df long").parquet(*done) if done else spark.createDataFrame([], "term string, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
