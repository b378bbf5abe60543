"""Queries of measurement: retrieval metrics, judgements, contracts, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import evaluate as E
from siftwell.operators import ranking as R
from siftwell.plans.registry import query, table
from siftwell.plans.retrieval import _cosine
from siftwell.plans.text import _EVAL_STOP

_HITS = f"h AS ({_cosine(6, -2)}), hits AS (SELECT h.query_id, rank - 1 AS rank, vec_id AS item FROM h WHERE h.query_id <> vec_id)"
_EV = f"""{_HITS}, src AS (SELECT a.vec_id AS query_id, b.vec_id AS item, a.label FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
 per AS (SELECT query_id, count(*) AS returned, count(s.label) AS found, min(CASE WHEN s.label IS NOT NULL THEN rank END) AS first FROM hits LEFT JOIN src s USING (query_id, item) GROUP BY 1),
 ev AS (SELECT query_id, any_value(label) AS label, round(max(found) / max(returned), 6) AS precision, round(max(found) / count(*), 6) AS recall, coalesce(max(found), 0) > 0 AS hit, round(coalesce(1.0 / max(first), 0.0), 6) AS reciprocal_rank
  FROM src LEFT JOIN per USING (query_id) GROUP BY query_id)"""


def _scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0")
    hits = R.cosine_top(v, q.select(F.col("vec_id").alias("query_id"), "embedding"), 6).where("query_id <> vec_id")
    hits = hits.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("item"))
    return E.scores_of_labels(hits, q.select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("item"), "label")), q


@query("ev01_retrieval_metrics", f"WITH {_EV} SELECT query_id, precision, recall, hit, reciprocal_rank FROM ev")
def retrieval_metrics(spark, sf_dir):
    return _scores(spark, sf_dir)[0]


@query("ev01_by_label", f"WITH {_EV} SELECT CAST(label AS BIGINT) AS label, count(*) AS questions, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(reciprocal_rank), 4) AS mrr FROM ev GROUP BY label")
def metrics_by_label(spark, sf_dir):
    scores, q = _scores(spark, sf_dir)
    rows = scores.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("label")), "query_id")
    mean = lambda c: F.round(F.avg(c), 4)
    return rows.groupBy("label").agg(F.count("*").alias("questions"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"))


_WORDS = rf"list_filter(list_distinct(regexp_extract_all(regexp_replace(lower({{c}}), '\[[0-9]+\]', ' ', 'g'), '[a-z0-9][a-z0-9\-.,]*[a-z0-9]|[a-z0-9]')), lambda w: NOT list_contains({_EVAL_STOP}, w))"


@query(
    "ev02_lexical_judge",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS.format(c="b.text")} AS a, {_WORDS.format(c="a.text")} AS e FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
    SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(e) > 0 THEN round(2 * len(list_intersect(a, e)) / (len(a) + len(e)), 6) ELSE -1 END AS correctness,
    CASE WHEN len(e) > 0 THEN CASE WHEN len(list_intersect(a, e)) > 0 THEN 1.0 ELSE 0.0 END ELSE -1 END AS context_relevance FROM p""",
)
def lexical_judge(spark, sf_dir):
    """A user's turn as what is expected and the next assistant's turn as answer and context; -1 for what can't be measured."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected"))
    answered = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"), F.col("text").alias("context"))
    rows = E.lexical_judgement(asked.join(answered, ["conv_id", "turn"]))
    return rows.select("conv_id", "turn", *[F.coalesce(n, F.lit(-1.0)).alias(n) for n in ("correctness", "context_relevance")])


@query("ev05_resume", "SELECT DISTINCT conv_id AS question_id FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3)")
def resume(spark, sf_dir):
    """Questions of a batch that still have no result."""
    c = table(spark, sf_dir, "conversations")
    done = c.where("turn >= 3").select("conv_id")
    return c.where("role = 'user'").select("conv_id").distinct().join(done, "conv_id", "left_anti").select(F.col("conv_id").alias("question_id"))


@query("ct07_dated_conflicts", "SELECT CAST(o_custkey AS BIGINT) AS custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates FROM orders GROUP BY o_custkey HAVING count(DISTINCT CAST(o_orderdate AS DATE)) >= 2")
def dated_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("custkey")).agg(F.countDistinct(F.to_date("o_orderdate")).alias("n_dates"))
    return rows.where("n_dates >= 2")


@query("flt12_refusals", "SELECT role, count(*) FILTER (WHERE contains(lower(text), 'could not find')) AS refusals, count(*) AS n FROM conversations GROUP BY role")
def refusals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(E.is_refusal(F.col("text"))).alias("refusals"), F.count("*").alias("n"))


_RESULTS = """r AS (SELECT event_type AS run, CASE WHEN user_id % 4 = 0 THEN 'lookup' WHEN user_id % 4 = 1 THEN 'comparison' ELSE 'other' END AS question_type, CASE WHEN value > 2 THEN value END AS latency, CASE WHEN value > 5 THEN value / 100 END AS score FROM events)"""


@query(
    "ag10_run_summary",
    f"""WITH {_RESULTS} SELECT run, coalesce(question_type, 'all') AS question_type, count(*) AS questions, round(avg(score), 4) AS mean_score, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, count(*) - count(score) AS unmeasured
    FROM r GROUP BY GROUPING SETS ((run, question_type), (run))""",
)
def run_summary(spark, sf_dir):
    """Means and nearest-rank percentiles over measured values, for each run and its question types, in one pass."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 4 == 0, "lookup").when(F.col("user_id") % 4 == 1, "comparison").otherwise("other")
    r = e.select(F.col("event_type").alias("run"), kind.alias("question_type"), F.when(F.col("value") > 2, F.col("value")).alias("latency"), F.when(F.col("value") > 5, F.col("value") / 100).alias("score"))
    rows = r.groupingSets([[F.col("run"), F.col("question_type")], [F.col("run")]], "run", "question_type").agg(
        F.count("*").alias("questions"), F.round(F.avg("score"), 4).alias("mean_score"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))], (F.count("*") - F.count("score")).alias("unmeasured"),
    )
    return rows.withColumn("question_type", F.coalesce("question_type", F.lit("all")))


@query(
    "ag11_router_agreement",
    """WITH s AS (SELECT user_id AS question, event_type AS target, avg(value) AS score FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2),
    b AS (SELECT question, max(score) FILTER (WHERE target = 'click') AS auto, max(score) FILTER (WHERE target <> 'click') AS best FROM s GROUP BY question)
    SELECT count(*) AS questions, count(*) FILTER (WHERE auto >= best - 1e-9) AS agreed FROM b WHERE auto IS NOT NULL AND best IS NOT NULL""",
)
def router_agreement(spark, sf_dir):
    """How often the routed target ("click") is at least as good as the best fixed one."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    s = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    auto = F.col("event_type") == "click"
    b = s.groupBy("user_id").agg(F.max(F.when(auto, F.col("score"))).alias("auto"), F.max(F.when(~auto, F.col("score"))).alias("best")).where("auto IS NOT NULL AND best IS NOT NULL")
    return b.agg(F.count("*").alias("questions"), F.count_if(F.col("auto") >= F.col("best") - 1e-9).alias("agreed"))


@query("ag12_matrix", "SELECT o_orderpriority AS category, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1")
def matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return rows.select("category", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


