"""Pages, newest rows, visibility, sections, cleaned texts, names and near vectors on small tables."""

from pyspark.sql import functions as F

from siftwell.functions import signals as S
from siftwell.functions import text as T
from siftwell.functions.names import name_key
from siftwell.operators import graph as G
from siftwell.operators import records as R


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_pages_cover_all_rows_once(spark):
    rows, seen, last = spark.range(23), [], None
    while page := [r.id for r in R.page_after(rows, "id", last, 5).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == list(range(23))


def test_firsts_and_phases(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 9), (4, "a", 3)], "run_id long, phase string, t long")
    assert ids(R.firsts(rows, ["phase"], ["t", "run_id"]), "run_id") == [2, 3]
    found = R.latest_phases(rows.withColumn("document_id", F.lit(7)), ["a", "b"]).first()
    assert (found.document_id, found.a, found.b) == (7, 4, None)


def test_visibility_needs_an_admitted_source(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    sources = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "id long, chunk_id long")
    admitted = spark.createDataFrame([(11,), (99,)], "chunk_id long")
    assert ids(R.visible(items, sources, admitted)) == [1] and ids(R.visible(items, sources, admitted.limit(0))) == []
    assert ids(R.scoped(items, None, "id")) == [1, 2, 3] and ids(R.scoped(items, items.limit(0), "id")) == []


def test_headings_in_force(spark):
    points = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 9, "c"), (2, 3, "d")], "doc_id long, start long, chunk string")
    headings = spark.createDataFrame([(1, 5, "One"), (1, 8, "Two")], "doc_id long, start long, title string")
    found = {r.chunk: r.section for r in R.headings_in_force(points, headings, ["doc_id"]).collect()}
    assert found == {"a": None, "b": "One", "c": "Two", "d": None}


def test_deletion_leaves_rows_without_document(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    left = R.without_documents({"x": rows}, spark.createDataFrame([(2,), (2,)], "doc_id long"))["x"]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]


def test_clean_text(spark):
    text = "Head\none-\ntwo\n\n\n\nFoot\fHead\nthree  x\nFoot\fHead\nFour\nFour\nFour\nfoot"
    found = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(T.clean_text(F.col("text")).alias("t")).collect()
    assert [r.t for r in found] == ["onetwo\n\nFoot\fthree x\nFoot\fFour\nFour\nFour\nfoot", "", None]


def test_unicode_keys(spark):
    names = ["Straße", "  ＡＣＭＥ,  Inc. ", "«(Platform Team)»", "atlas (beta)", "c#", ".net", "(a)(b)", "“Q?”!", None, "...", "((x))"]
    found = spark.createDataFrame(list(enumerate(names)), "i long, n string").select("i", name_key("n").alias("k")).orderBy("i").collect()
    assert [r.k for r in found] == ["strasse", "acme, inc", "platform team", "atlas (beta)", "c#", ".net", "(a)(b)", "q", None, "", "x"]


def test_similar_pairs_stay_within_a_label(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 1.0], "a"), (5, [1.0, 0.0], None), (6, [1.0, 0.0, 0.0], "a"), (7, None, "a"), (8, [1.0, 0.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = G.similar_pairs(vectors, vectors.where("vec_id IN (1, 4, 5)"), 0.5).collect()
    assert [(r.vec_id, r.other) for r in found] == [(1, 2)]
    assert G.similar_pairs(vectors, vectors.limit(0), 0.5).count() == 0 == G.similar_pairs(vectors.limit(0), vectors, 0.5).count()


def test_signals_and_routes(spark):
    asked = ["Who reports to Mary Ann Lee in Oslo?", "find “exact words” and \"more\"", "compare \"a\" with b", "What does HTTP2 do", "The Team owns what " + "word " * 20, "word " * 20, ""]
    rows = spark.createDataFrame(list(enumerate(asked)), "i long, question string")
    signals = rows.select("i", *[c.alias(n) for n, c in S.signal_columns(F.col("question")).items()])
    found = {r.i: r for r in signals.collect()}
    assert (found[0].entities, found[0].relations) == ("Mary Ann Lee,Oslo", "REPORTS_TO") and found[1].n_phrases == 2 and found[3].entities == ""
    routes = lambda available: {r.i: r for r in signals.select("i", *[c.alias(n) for n, c in S.route(available).items()]).collect()}
    every = routes(S.STRATEGIES)
    assert [(every[i].strategy, every[i].decisive, every[i].from_rule, every[i].query_type) for i in range(7)] == [
        ("graph", True, True, "relationship"), ("vectorless", True, True, "exact_match"), ("agentic", False, False, "ambiguous"), ("vectorless", True, True, "exact_match"),
        ("graph", True, True, "relationship"), ("traditional", False, False, "ambiguous"), ("traditional", True, False, "simple_factual"),
    ]
    assert every[2].ranking == "agentic,vectorless,traditional,graph"
    offline = routes(["traditional", "vectorless"])
    assert (offline[0].strategy, offline[0].decisive, offline[0].from_rule, offline[0].query_type) == ("traditional", True, False, "relationship")
    assert (offline[2].strategy, offline[2].from_rule, offline[2].query_type) == ("vectorless", True, "exact_match")


def test_scores_are_held_in_slices(spark, monkeypatch):
    """The same best vectors whatever the number of scores that a task holds at once."""
    import random

    from siftwell.operators import ranking

    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, ranking.cosine_top(vectors, queries, 4).collect()))
    monkeypatch.setattr(ranking, "CELLS", 70)
    assert sorted(map(tuple, ranking.cosine_top(vectors, queries, 4).collect())) == whole and len(whole) == 60


def test_headings(spark):
    lines = ["# Title ", "  ## Two words", "#none", "1. First:", "2.3 Second", "ALL CAPS", "ALL CAPS:", "AB", "Üb ER", "ÜBER 3", "漢字漢字", "", "   ", "#", "A" * 81, "12", None, "\t3) x."]
    found = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", T.heading(F.col("line")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == ["Title", "Two words", None, "1. First:", "2.3 Second", "ALL CAPS", None, None, None, "ÜBER 3", None, None, None, None, None, None, None, "3) x."]
