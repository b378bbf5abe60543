"""Where named queries and their SQL are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with DuckDB SQL for its rows."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Wordings of several kinds that questions end in, as the invented prose of users' turns has none.
WORDINGS = [
    "the reason for others",
    "here and there another one that is on",
    'where is "of the" with these',
    "compare der die das with le la les",
    "What reports to Anble in el los las",
    "find ERR_QUOTA_44 in then and the",
    "How many things that are in here? And which of them?",
    "how many days of the est the et de",
]
WORDINGS_SQL = "([" + ", ".join("'" + w.replace("'", "''") + "'" for w in WORDINGS) + "])"
QUESTIONS_SQL = f"(SELECT conv_id * 1000 + turn AS query_id, text || ' ' || {WORDINGS_SQL}[conv_id // 20 % 8 + 1] AS question FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 AND text IS NOT NULL)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question: users' turns of the conversations whose id is divisible by 20, whole, with a wording after them."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 20 = 0 AND text IS NOT NULL")
    wording = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.floor(F.col("conv_id") / 20) % 8 + 1).cast("int"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", F.lit(" "), wording).alias("question"))
