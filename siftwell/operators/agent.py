"""Retrieve, assess and repair for sets of questions at once: the state of all of them is a few tables, and a round is a plan over those.

questions (question_id, question) are split into sub-questions; each round searches for the open ones, adds what is new to the question's evidence, judges
which sub-questions it answers, and changes how the others are asked. A question stops when all its sub-questions are answered or abandoned (resolved), when a round finds
nothing new (no_progress), or when the next step would break a cap (budget). Verdicts and moves are rules, so a run is the same each time; calls are counted as a model's
would be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import content_tokens
from siftwell.operators import repair as R
from siftwell.operators.lineage import cut
from siftwell.operators.ranking import hint

#: Share of a sub-question's content words that its evidence must have to answer it; passages asked for at first.
ENOUGH, TOP_K = 0.6, 5
NODES = ["plan", "assess", "repair"]
#: question_id, sub_id, query, top_k and tool of the open sub-questions, to question_id, sub_id, chunk_id and text.
Search = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    """Rounds, calls of a question, and calls by node where a node has a cap of its own."""

    iterations: int = 4
    calls: int = 12
    per_node: dict[str, int] = field(default_factory=dict)

    def left(self, node: str) -> Column:
        """Calls that a question may still spend at a node."""
        own = self.per_node.get(node)
        room = self.calls - F.col("calls")
        return F.greatest(F.lit(0), room if own is None else F.least(room, own - F.col(node)))


@dataclass
class Runs:
    """sub_questions (question_id, sub_id, text, query, top_k, tool, tried, status, reason), evidence (question_id, sub_id, chunk_id) and ledger (question_id, iterations, calls, a count a
    node, stop)."""

    sub_questions: DataFrame
    evidence: DataFrame
    ledger: DataFrame


def spent(ledger: DataFrame, node: str, n: Column) -> DataFrame:
    return ledger.withColumns({"calls": F.col("calls") + n, node: F.col(node) + n})


def stopped(ledger: DataFrame, when: Column, reason: str) -> DataFrame:
    """The first reason to stop stays."""
    return ledger.withColumn("stop", F.coalesce("stop", F.when(when, reason)))


def wanted_words(subs: DataFrame) -> DataFrame:
    """question_id, sub_id, words: the content words of sub-questions. A sub-question's text never changes."""
    return subs.select("question_id", "sub_id", F.array_distinct(content_tokens(F.col("text"))).alias("words"))


def verdicts(open_: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, sub_id, share of the content words that the sub-question's own evidence (own: what a passage has of them) has, missing (those it hasn't) and has_evidence."""
    wanted = wanted_words(open_)
    have = evidence.join(wanted.select("question_id", "sub_id"), ["question_id", "sub_id"], "left_semi")
    have = have.groupBy("question_id", "sub_id").agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"))
    rows = wanted.join(have, ["question_id", "sub_id"], "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    share = F.when(F.size("words") > 0, F.size(own) / F.size("words")).otherwise(0.0)
    return rows.select("question_id", "sub_id", share.alias("share"), F.array_join(F.array_except("words", own), " ").alias("missing"), F.col("own").isNotNull().alias("has_evidence"))


def moved(asked: DataFrame, tools: list[str]) -> DataFrame:
    """Sub-questions (with missing and has_evidence) after their next move, and the parts of those that were split, with a null sub_id and status open."""
    compound = F.size(R.parts(F.col("query"))) > 1
    rows = asked.withColumn("move", R.next_move(F.lit(None).cast("string"), F.col("tried"), F.col("has_evidence"), F.lit(False), compound))
    is_ = lambda name: F.col("move") == name
    following = F.create_map(*[F.lit(x) for a, b in zip(tools, tools[1:] + tools[:1]) for x in (a, b)])[F.col("tool")]
    query = F.when(is_("broaden"), R.broadened(F.col("query"))).when(is_("narrow"), R.narrowed(F.col("query"), F.col("missing"))).otherwise(F.col("query"))
    top_k = F.when(is_("broaden"), R.wider(F.col("top_k"))).when(is_("narrow"), R.narrower(F.col("top_k"))).otherwise(F.col("top_k"))
    gone = is_("abandon") | is_("decompose")
    after = rows.select(
        "question_id", "sub_id", "text", query.alias("query"), top_k.cast("int").alias("top_k"), F.when(is_("switch_strategy"), following).otherwise(F.col("tool")).alias("tool"), F.concat("tried", F.array("move")).alias("tried"),
        F.when(gone, "abandoned").otherwise(F.col("status")).alias("status"), F.when(is_("abandon"), "no move is left").when(is_("decompose"), "split into its parts").alias("reason"),
    )
    parts = rows.where(is_("decompose")).select("question_id", F.col("sub_id").alias("of"), F.posexplode(R.parts(F.col("query"))).alias("part", "text"), "tool")
    return after, parts


def run_agents(questions: DataFrame, search: Search, limits: Limits = Limits(), tools: list[str] = ["lexical"], enough: float = ENOUGH) -> Runs:
    """Rounds until every question has stopped. Null questions are empty ones, whose only sub-question nothing answers. A plan costs a call, so does each round's assessment of
    a question and each repair of a sub-question; what the caps don't allow isn't done, and repairs go in order of sub_id as far as they reach."""
    key = ["question_id", "sub_id"]
    start = questions.select("question_id", *[F.lit(0).alias(c) for c in ("iterations", "calls", *NODES)], F.lit(None).cast("string").alias("stop"))
    planned = limits.left("plan") >= 1
    ledger = cut(spent(stopped(start, ~planned, "budget"), "plan", planned.cast("int")))
    own = questions.join(ledger.where("stop IS NULL").select("question_id"), "question_id", "left_semi").select("question_id", F.posexplode(R.parts(F.coalesce("question", F.lit("")))).alias("sub_id", "text"))
    none = F.array().cast("array<string>")
    fresh = lambda t: t.select(*key, "text", F.col("text").alias("query"), F.lit(TOP_K).alias("top_k"), "tool", none.alias("tried"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("reason"))
    subs, evidence = cut(fresh(own.withColumn("tool", F.lit(tools[0])))), None
    for number in range(1, limits.iterations + 2):
        ledger = cut(stopped(ledger, F.lit(number > limits.iterations), "budget"))
        going = ledger.where("stop IS NULL").select("question_id")
        if going.isEmpty():
            break
        asked = subs.where("status = 'open'").join(going, "question_id", "left_semi")
        hits = search(asked.select(*key, "query", "top_k", "tool")).select(*key, "chunk_id", "text").join(hint(asked)(wanted_words(asked)), key)
        # of a passage's text only the words that are asked for go on: texts are neither exchanged nor kept
        found = cut(hits.select(*key, "chunk_id", F.array_intersect("words", content_tokens(F.col("text"))).alias("own")).dropDuplicates([*key, "chunk_id"]))
        new = found.select("question_id", "chunk_id") if evidence is None else found.select("question_id", "chunk_id").join(evidence, ["question_id", "chunk_id"], "left_anti")
        evidence = cut(found if evidence is None else evidence.unionByName(found.join(evidence, [*key, "chunk_id"], "left_anti")))
        on = F.col("stop").isNull()
        ledger = ledger.withColumn("iterations", F.when(on, number).otherwise(F.col("iterations"))).join(new.select("question_id").distinct().withColumn("__new", F.lit(True)), "question_id", "left")
        ledger = stopped(ledger, F.lit(number > 1) & F.col("__new").isNull(), "no_progress").drop("__new")
        able = limits.left("assess") >= 1
        ledger = cut(spent(stopped(ledger, ~able, "budget"), "assess", (on & able).cast("int")))
        judged = asked.join(ledger.where(on).select("question_id"), "question_id", "left_semi")
        told = cut(verdicts(judged, evidence))
        subs = subs.join(told.where(F.col("share") >= enough).select(*key, F.lit(True).alias("__answered")), key, "left")
        subs = cut(subs.withColumn("status", F.when(F.col("__answered"), "answered").otherwise(F.col("status"))).drop("__answered"))
        n_open = subs.where("status = 'open'").groupBy("question_id").agg(F.count("*").cast("int").alias("__open"))
        ledger = cut(stopped(ledger.join(n_open, "question_id", "left"), F.col("__open").isNull(), "resolved").withColumn("__able", F.when(on, F.least(F.coalesce("__open", F.lit(0)), limits.left("repair"))).otherwise(0)))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy("sub_id"))
        due = subs.where("status = 'open'").join(ledger.where("__able > 0").select("question_id", "__able"), "question_id").withColumn("__place", place).where(F.col("__place") <= F.col("__able"))
        due = cut(due.drop("__able", "__place").join(told.select(*key, "missing", "has_evidence"), key))
        after, parts = moved(due, tools)
        last = subs.groupBy("question_id").agg(F.max("sub_id").alias("__last"))
        nth = F.row_number().over(Window.partitionBy("question_id").orderBy("of", "part"))
        parts = parts.join(last, "question_id").withColumn("sub_id", F.col("__last") + nth)
        subs = cut(reduce(DataFrame.unionByName, [subs.join(due.select(*key), key, "left_anti"), after, fresh(parts)]))
        open_now = subs.where("status = 'open'").select("question_id").distinct().withColumn("__still", F.lit(True))
        short = on & (F.coalesce("__open", F.lit(0)) > F.col("__able"))
        ledger = stopped(spent(ledger, "repair", F.col("__able")), short, "budget").join(open_now, "question_id", "left")
        ledger = cut(stopped(ledger, F.col("__still").isNull(), "resolved").drop("__still", "__open", "__able"))
    held = evidence.select(*key, "chunk_id") if evidence is not None else subs.select(*key, F.lit(None).cast("long").alias("chunk_id")).limit(0)
    return Runs(subs, held, ledger)
