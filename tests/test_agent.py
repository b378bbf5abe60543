from pyspark.sql import functions as F

from siftwell.functions.text import content_tokens
from siftwell.operators import agent as A

CHUNKS = [(1, "the travel limit is ninety dollars"), (2, "casual leave lasts ten days"), (3, "travel claims go to finance"), (4, "ninety days of parental leave")]


def searcher(spark, chunks=CHUNKS, tool=None):
    """Chunks that have the most words of the query, top_k of them; another tool than `tool` finds nothing."""
    texts = spark.createDataFrame(chunks, "chunk_id long, text string")
    words = texts.select("chunk_id", "text", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("w"))

    def search(asked):
        rows = asked if tool is None else asked.where(F.col("tool") == tool)
        rows = rows.select("question_id", "sub_id", "top_k", F.explode(F.array_distinct(content_tokens(F.col("query")))).alias("w"))
        hits = rows.join(words, "w").groupBy("question_id", "sub_id", "top_k", "chunk_id", "text").agg(F.count("*").alias("n"))
        place = F.row_number().over(A.Window.partitionBy("question_id", "sub_id").orderBy(F.desc("n"), "chunk_id"))
        return hits.withColumn("place", place).where("place <= top_k")

    return search


def run(spark, questions, limits=A.Limits(), parts=2, **more):
    rows = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string").repartition(parts)
    found = A.run_agents(rows, more.pop("search", searcher(spark)), limits, **more)
    ledger = {r.question_id: (r.iterations, r.calls, r.plan, r.assess, r.repair, r.stop) for r in found.ledger.collect()}
    subs = {}
    for r in found.sub_questions.orderBy("question_id", "sub_id").collect():
        subs.setdefault(r.question_id, []).append((r.text, r.status, r.tried, r.query, r.reason))
    evidence = {}
    for r in found.evidence.collect():
        evidence.setdefault(r.question_id, set()).add(r.chunk_id)
    return ledger, subs, evidence


def test_answered_at_once(spark):
    ledger, subs, evidence = run(spark, ["What is the travel limit", "How long lasts casual leave and what is the travel limit", None])
    assert ledger[0] == (1, 2, 1, 1, 0, "resolved") and subs[0][0][1] == "answered" and 1 in evidence[0]
    assert ledger[1] == (1, 2, 1, 1, 0, "resolved") and [s[1] for s in subs[1]] == ["answered", "answered"] and {1, 2} <= evidence[1]
    assert ledger[2][5] in ("no_progress", "resolved") and subs[2][0][1] != "answered" and 2 not in evidence


def test_repairs_until_nothing_is_new(spark):
    ledger, subs, evidence = run(spark, ["exactly which quantum yak dollars"], A.Limits(6, 30))
    assert ledger[0][5] == "no_progress" and ledger[0][0] == 2 and subs[0][0][1] == "open"
    assert subs[0][0][2] == ["narrow"] and evidence[0] == {1}


def test_nothing_found_is_broadened_and_given_up(spark):
    none = lambda asked: asked.select("question_id", "sub_id", F.lit(1).cast("long").alias("chunk_id"), F.lit("x").alias("text")).limit(0)
    ledger, subs, _ = run(spark, ["zebra crossings"], A.Limits(9, 30), search=none)
    assert ledger[0] == (2, 3, 1, 1, 1, "no_progress") and subs[0][0][2] == ["broaden"]


def test_another_tool_finds_it(spark):
    """The first tool finds less and less; a new chunk each round keeps it going until the other tool answers."""
    base = searcher(spark, tool="vector")

    def search(asked):
        junk = asked.where("tool = 'lexical'").select("question_id", "sub_id", F.hash("query", F.lit(7)).cast("long").alias("chunk_id"), F.lit("junk").alias("text"))
        return base(asked).select("question_id", "sub_id", "chunk_id", "text").unionByName(junk)

    ledger, subs, _ = run(spark, ["exactly what casual leave lasts"], A.Limits(6, 30), search=search, tools=["lexical", "vector"])
    assert subs[0][0][1] == "answered" and subs[0][0][2] == ["narrow", "switch_strategy"] and ledger[0][5] == "resolved" and ledger[0][0] == 3


def test_caps(spark):
    many = "casual zebra yaks and travel quantum gnus and ninety purple okapis"
    assert run(spark, ["travel limit"], A.Limits(4, 0))[0][0] == (0, 0, 0, 0, 0, "budget")
    assert run(spark, ["travel limit"], A.Limits(4, 1))[0][0] == (1, 1, 1, 0, 0, "budget")
    ledger, subs, _ = run(spark, [many], A.Limits(4, 4))
    assert ledger[0] == (1, 4, 1, 1, 2, "budget") and [len(s[2]) for s in subs[0]] == [1, 1, 0]
    ledger, subs, _ = run(spark, [many], A.Limits(4, 30, {"repair": 1}))
    assert ledger[0] == (1, 3, 1, 1, 1, "budget") and [len(s[2]) for s in subs[0]] == [1, 0, 0]
    assert run(spark, [many], A.Limits(0, 30))[0][0] == (0, 1, 1, 0, 0, "budget")


def test_texts_of_passages_are_not_kept(spark, monkeypatch):
    kept, plain = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df: kept.append(df.columns) or plain(df))
    ledger, subs, _ = run(spark, ["travel limit"])
    assert ledger[0][5] == "resolved" and subs[0][0][1] == "answered"
    assert any("own" in c for c in kept) and not any({"chunk_id", "text"} <= set(c) for c in kept)


def test_the_same_whatever_the_partitions(spark):
    asked = ["travel zebra limit and casual okapi leave", "", "ninety days", "exactly quantum"] * 3
    assert run(spark, asked, parts=1) == run(spark, asked, parts=7)
