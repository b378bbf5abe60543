"""A queue of jobs as a stream: every job is tried a few times, and those that fail for good are dead letters.

Each batch writes the outcomes of its jobs to a folder of its own, so a batch that runs again replaces them and changes nothing. What failed in earlier
batches is tried again with the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.lineage import files_of

JOBS = "job_id long, kind string, document_id long, payload string"
OUTCOMES = f"{JOBS}, attempt int, error string, result string, batch long"
ATTEMPTS, ERROR_LENGTH = 3, 500
#: A handler turns jobs (JOBS) into job_id, error (null: done) and result (text). A job without a row counts as failed.
Handler = Callable[[DataFrame], DataFrame]


def _batches(spark: SparkSession, target: str) -> dict[int, str]:
    """Folders of the batches whose outcomes are whole."""
    where, files = files_of(spark, target)
    if not files.exists(where):
        return {}
    found = {int(f.getPath().getName().split("=")[1]): f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("batch=")}
    return {b: p.toString() for b, p in found.items() if files.exists(files_of(spark, f"{p}/_SUCCESS")[0])}


def outcomes(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """All outcomes, or those of the batches before one. No rows before the first batch."""
    paths = [p for b, p in _batches(spark, target).items() if before is None or b < before]
    return spark.read.schema(OUTCOMES).parquet(*paths) if paths else spark.createDataFrame([], OUTCOMES)


def statuses(tried: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """The last outcome of each job, with its status: done, pending (it will be tried again) or failed (a dead letter)."""
    last = tried.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in tried.columns if c != "job_id"]), F.struct("attempt", "batch")).alias("o")).select("job_id", "o.*")
    return last.withColumn("status", F.when(F.col("error").isNull(), "done").when(F.col("attempt") >= attempts, "failed").otherwise("pending"))


def failed_documents(tried: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """document_id and error of the documents that a dead letter is about, the last one's."""
    dead = statuses(tried, attempts).where("status = 'failed' AND document_id IS NOT NULL")
    return dead.groupBy("document_id").agg(F.max_by(F.substring(F.concat("kind", F.lit(" failed: "), "error"), 1, ERROR_LENGTH), F.struct("batch", "job_id")).alias("error"))


def handled(jobs: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """job_id, error, result of all jobs, each by the handler of its kind."""
    own = [handler(jobs.where(F.col("kind") == kind).select(*[c.split()[0] for c in JOBS.split(", ")])).select("job_id", "error", "result") for kind, handler in handlers.items()]
    done = reduce(DataFrame.unionByName, own) if own else jobs.select("job_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("result")).limit(0)
    rows = jobs.select("job_id", "kind").join(done.withColumn("met", F.lit(True)), "job_id", "left")
    known = F.coalesce(F.col("kind").isin(list(handlers)), F.lit(False))
    error = F.when(~known, F.concat(F.lit("no handler for job kind "), F.coalesce("kind", F.lit("null")))).when(F.col("met").isNull(), "the handler returned nothing").otherwise(F.col("error"))
    return rows.select("job_id", error.alias("error"), F.when(error.isNull(), F.col("result")).alias("result"))


def consume(jobs: DataFrame, target: str, checkpoint: str, handlers: dict[str, Handler], attempts: int = ATTEMPTS) -> StreamingQuery:
    """Runs the jobs of a stream (JOBS) that have arrived. Of a job that comes twice the first counts, and one that is done isn't done again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = statuses(outcomes(spark, target, number), attempts)
        new = batch.dropDuplicates(["job_id"]).join(earlier.select("job_id"), "job_id", "left_anti").withColumn("attempt", F.lit(1))
        again = earlier.where("status = 'pending'").withColumn("attempt", F.col("attempt") + 1)
        own = [c.split()[0] for c in JOBS.split(", ")]
        due = new.select(*own, "attempt").unionByName(again.select(*own, "attempt"))
        found = due.join(handled(due, handlers), "job_id").withColumn("batch", F.lit(number).cast("long"))
        found.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in OUTCOMES.split(", ")]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
