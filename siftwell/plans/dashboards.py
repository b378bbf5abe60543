"""Queries of operation: overviews, latencies, costs, rates, and a few extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators.limits import decided, limited
from siftwell.plans.registry import query, table

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("ag02_overview", "SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'collections', count(DISTINCT source) FROM documents UNION ALL SELECT 'queries', count(*) FROM conversations WHERE role = 'user' UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def overview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("collections"))
    rows = docs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("documents", "collections")])).alias("m")).select("m.*")
    one = lambda name, df: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    return rows.unionByName(one("queries", table(spark, sf_dir, "conversations").where("role = 'user'"))).unionByName(one("vectors", table(spark, sf_dir, "embeddings")))


@query("ag03_top_collections", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_collections(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("ag04_most_cited", f"SELECT k AS doc_id, coalesce(source, '(deleted)') AS name, n FROM (SELECT {_K} AS k, count(*) AS n FROM events GROUP BY 1) LEFT JOIN (SELECT doc_id, source FROM documents WHERE lang = 'en') ON doc_id = k ORDER BY n DESC, k LIMIT 5")
def most_cited(spark, sf_dir):
    cited = table(spark, sf_dir, "events").groupBy(_k().alias("doc_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5)
    names = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")
    return names.join(F.broadcast(cited), "doc_id", "right").select("doc_id", F.coalesce("source", F.lit("(deleted)")).alias("name"), "n")


@query("ag05_latency_percentiles", "SELECT event_type AS strategy, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))])


@query("ag06_calls", f"SELECT event_type AS strategy, count(*) AS runs, CAST(sum({_K}) AS BIGINT) AS llm_calls FROM events GROUP BY 1")
def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("runs"), F.sum(_k()).alias("llm_calls"))


@query("ag07_cost_per_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS runs, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS unpriced_runs, round(sum(CASE WHEN event_type NOT IN ('error', 'view') THEN value / 1000 END), 6) AS cost FROM events GROUP BY 1")
def cost_per_day(spark, sf_dir):
    cost = F.when(~F.col("event_type").isin("error", "view"), F.col("value") / 1000)
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("runs"), F.count_if(cost.isNull()).alias("unpriced_runs"), F.round(F.sum(cost), 6).alias("cost"))


@query("ag08_fallback_rate", "SELECT count(*) AS runs, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate FROM events")
def fallback_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 4).alias("fallback_rate"))


@query("ag09_trend", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 4) AS mean_value FROM events WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1")
def trend(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("t")).first().t
    rows = e.where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit(last) - F.expr("INTERVAL 10 DAYS"))) if last else e.limit(0)
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 4).alias("mean_value"))


_PRICES = [("click", 3.0), ("pur*", 1.5), ("p*", 9.0), ("view", 0.0)]
_PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', {p})" for m, p in _PRICES) + ") AS v(model, price)"


@query(
    "ag19_cost_lookup",
    f"""WITH m AS (SELECT event_type, CAST(sum({_K}) AS BIGINT) AS tokens FROM events GROUP BY 1), c AS (SELECT event_type, tokens, price, CASE WHEN model = event_type THEN 1000 ELSE length(model) END AS fit FROM m JOIN {_PRICES_SQL} ON model = event_type OR (ends_with(model, '*') AND starts_with(event_type, rtrim(model, '*')))),
    b AS (SELECT event_type, arg_max(price, fit) AS price FROM c GROUP BY 1) SELECT event_type AS model, tokens, price IS NOT NULL AND price > 0 AS priced, CASE WHEN price > 0 THEN round(tokens * price / 1000000, 8) ELSE -1 END AS usd FROM m LEFT JOIN b USING (event_type)""",
)
def cost_lookup(spark, sf_dir):
    """Prices a million tokens by exact name, else the longest prefix; -1 for free or unknown models. Prefixes of a name are its
    keys, so the lookup is an equi-join."""
    prices = F.broadcast(spark.createDataFrame(_PRICES, "key string, price double"))
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum(_k()).alias("tokens"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.concat(F.substring("model", F.lit(1), i), F.lit("*")))
    keys = m.select("model", F.explode(F.concat(F.array("model"), prefixes)).alias("key"))
    fit = F.when(F.col("key") == F.col("model"), 1000).otherwise(F.length("key"))
    best = keys.join(prices, "key").groupBy("model").agg(F.max_by("price", fit).alias("price"))
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    return m.join(best, "model", "left").select("model", "tokens", priced.alias("priced"), F.when(priced, F.round(F.col("tokens") * F.col("price") / 1e6, 8)).otherwise(-1.0).alias("usd"))


@query(
    "ac02_rate_limit",
    "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 2",
)
def rate_limit(spark, sf_dir):
    rows = limited(table(spark, sf_dir, "events"), "user_id", "ts", 2, "1 hour").where("rejected > 0")
    return rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", "rejected")


@query(
    "ac02_decisions",
    """SELECT event_id, rn <= 2 AS allowed, greatest(2 - rn, 0) AS remaining, CAST(greatest(1, ceil((3600000000 - epoch_us(ts) % 3600000000) / 1000000)) AS BIGINT) AS retry_after
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events)""",
)
def rate_decisions(spark, sf_dir):
    return decided(table(spark, sf_dir, "events"), "user_id", "ts", 2, 3600).select("event_id", "allowed", "remaining", "retry_after")


@query("ext_cube", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query(
    "ext_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY user_id""",
)
def sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
