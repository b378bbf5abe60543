"""Repair moves and edge lists on small cases."""

from pyspark.sql import functions as F

from siftwell.operators import repair as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_broadened(spark):
    cases = {
        "what is the exact limit for the payments API": "what is the limit",
        "limit when in doubt for all": "limit",
        "what is the limit": "limit",
        "Currently, limits": "limits",
        "the of": "the of",
        "": "",
    }
    assert {q: one(spark, R.broadened(F.lit(q))) for q in cases} == cases
    assert one(spark, R.broadened(F.lit(None).cast("string"))) is None


def test_narrowed(spark):
    assert one(spark, R.narrowed(F.lit("limit"), F.lit(" per Year "))) == "limit per Year"
    assert one(spark, R.narrowed(F.lit("limit PER year"), F.lit("per Year"))) == "limit PER year"
    assert one(spark, R.narrowed(F.lit("limit"), F.lit(None).cast("string"))) == "limit"


def test_parts(spark):
    assert one(spark, R.parts(F.lit("what is a leave AND what is a limit and who may sign"))) == ["what is a leave", "what is a limit", "who may sign"]
    assert one(spark, R.parts(F.lit("where are the terms and conditions"))) == ["where are the terms and conditions"]
    # the first splitter leaves a part that is too short, the next doesn't
    assert one(spark, R.parts(F.lit("plan vs what one costs and what two cost"))) == ["plan vs what one costs", "what two cost"]


def test_next_move(spark):
    def move(proposed, tried, evidence=False, document=False, compound=False):
        given = F.array(*map(F.lit, tried)) if tried else F.array().cast("array<string>")
        return one(spark, R.next_move(F.lit(proposed).cast("string"), given, F.lit(evidence), F.lit(document), F.lit(compound)))

    assert move(None, []) == "broaden" and move(None, [], evidence=True) == "narrow"
    assert move("abandon", []) == "broaden" and move("abandon", ["broaden"]) == "abandon"
    assert move("decompose", [], compound=True) == "decompose" and move("decompose", []) == "broaden"
    assert move("narrow", ["narrow"], evidence=True) == "switch_strategy"
    assert move(None, ["broaden", "switch_strategy"], document=True) == "fetch_document"
    assert move(None, ["broaden", "switch_strategy", "narrow"]) == "abandon"


def test_edge_lines(spark):
    edges = spark.createDataFrame([(1, 1, 7, "Ann", "Bo", "REPORTS_TO", False), (1, 2, 8, "Ann", "Rome", "HOLDS", True)], "walk_id int, k long, edge_id long, source_name string, target_name string, walked_as string, reversed boolean")
    sources = spark.createDataFrame([(7, 50), (7, 51), (7, 50), (8, 99)], "edge_id long, chunk_id long")
    passages = spark.createDataFrame([(1, 2, 50), (1, 10, 51), (2, 1, 99)], "walk_id int, n long, chunk_id long")
    lines = {r.k: r.line for r in R.edge_lines(edges, sources, passages).collect()}
    assert lines == {1: "[E 1] Ann REPORTS_TO Bo (source passages: [2], [10])", 2: "[E 2] Rome HOLDS Ann (source passages: none provided)"}
