"""Sentences, claims, support and misplaced citations, case by case."""

import time

import pytest
from pyspark.sql import functions as F

from siftwell.operators import claims as C
from siftwell.operators import evaluate as E

SCHEMA = "answer_id long, answer string, contexts array<string>"


def answers(spark, *rows):
    return spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    "answer, contexts, violation",
    [
        ("Ten days are given [1].", ["Ten days are given.", "Other"], None),
        ("See [3] and [1].", ["a", "b"], "marker_out_of_range"),
        ("No citation here.", ["a"], "uncited"),
        ("I could not find that.", ["a"], None),
        ('It says "ten full days" [2].', ["Ten  Full days", "none of it"], "quote_not_found"),
        ('It says "ten full days" [1].', ["They get Ten  Full\ndays off", "none of it"], None),
        ("[1]", ["a"], "no_words"),
        ('Only "7 d" [1] and "tiny" [1].', ["within 7 d or so"], None),
        ("", [], "no_words"),
    ],
)
def test_contract(spark, answer, contexts, violation):
    found = answers(spark, (answer, contexts)).select(E.contract_violation(F.col("answer"), F.col("contexts")).alias("v"))
    assert found.first().v == violation


@pytest.mark.parametrize(
    "answer, claims",
    [
        ("One. Two! [1] Three?", ["One.", " Two!", " [1] Three?"]),
        ("Five attempts. [1].", ["Five attempts. [1]."]),
        ('They say "a. b! c" [1]. So.', ['They say "a. b! c" [1].', " So."]),
        ('Open "a. b! c [1]. So.', ['Open "a. b! c [1]. So.']),
        ("[1]", ["[1]"]),
        ("", []),
        ("v 1.5 é.", ["v 1.", "5 é."]),
    ],
)
def test_claims(spark, answer, claims):
    assert answers(spark, (answer, [])).select(C.claims(F.col("answer")).alias("c")).first().c == claims


def test_spans_are_places_in_the_text(spark):
    texts = ["A b.  C d!\n\nE\nf. ", " \n ", "", None, "x" * 100_000, "é. ü"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = C.sentence_spans(rows, ["doc_id"]).orderBy("doc_id", "start").collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence for r in found)
    assert [r.sentence for r in found if r.doc_id == 0] == ["A b.", "C d!", "E", "f."] and {r.doc_id for r in found} == {0, 4, 5}
    assert C.sentence_spans(rows.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    "answer, contexts, found",
    [
        ("Leave is 12 days [1].", ["Leave is ten days.", "Leave is 12 days."], [("12 days", [1], [2])]),
        ("Leave is 12 days [1][2].", ["Leave is ten days.", "Leave is 12 days."], []),
        ("According to [1] leave is 1,200 days.", ["ten", "1200 days"], [("1200 days", [1], [2])]),
        ("[1] Leave is 12 days.", ["ten", "12 days"], [("12 days", [1], [2])]),
        ("In 2024 AB-77 held [2].", ["the ab-77 form of 2024", "none"], [("ab-77", [2], [1])]),
        ('It says "the full text" [1].', ["none", "here is The  full text of it"], [("the full text", [1], [2])]),
        ("Leave is 12 days [1].", ["ten", "112 days", "12 daysies"], [("12 days", [1], [3])]),
        ("Leave is 12 days [7].", ["ten", "12 days"], []),
        ("", ["a"], []),
    ],
)
def test_misattributions(spark, answer, contexts, found):
    rows = answers(spark, (answer, contexts)).select(C.misattributions(F.col("answer"), F.col("contexts")).alias("m")).first().m
    assert [(m.phrase, m.cited, m.holders) for m in rows] == found


def test_citation_check_and_dropped_claims(spark):
    c = ["Leave is twelve days each year.", "The office opens at 9 hours."]
    rows = answers(
        spark, ("Leave is twelve days [1].", c), ("Leave is twelve days [2].", c), ("The office opens at 9 hours [1].", c), ("  ", c), ("I could not find it.", c), ("I could not find it.", []),
        ("Nothing is cited.", c), ("Leave is twelve days [1]. The sea is blue. [1]", c), ("The year: leave is 9 hours [1].", c),
    )
    found = C.citation_check(rows).orderBy("answer_id").collect()
    assert [(r.correct, r.reason) for r in found[:7]] == [
        (True, None), (False, "unsupported"), (False, "unsupported"), (None, "empty"), (False, "refused_with_passages"), (True, None), (False, "uncited"),
    ]
    assert found[8].reason == "misattributed"
    dropped = C.drop_unsupported(rows).orderBy("answer_id").collect()
    assert dropped[7].kept == "Leave is twelve days [1]. The sea is blue. [1]" and not dropped[7].dropped
    assert dropped[6].kept == "" and [d.reason for d in dropped[6].dropped] == ["uncited"]


def test_support(spark):
    text = "# Leave policy\n- Annual leave lasts twelve days.\nThe office has a garden. Leave."
    chunks = [("q", 1, text, None, "annual leave policy"), ("q", 2, text, 0.0, "annual leave policy"), ("q", 3, "Nothing here.", 0.5, "annual leave policy"), ("q", 4, text, 0.5, "annual leave policy"), ("l", 1, "leave " * 100, None, "leave")]
    found = C.select_support(spark.createDataFrame(chunks, "query_id string, rank int, text string, score double, question string"))
    rows = {(r.query_id, r.rank): r for r in found.collect()}
    assert set(rows) == {("q", 1), ("l", 1)}
    best = rows["q", 1]
    assert best.text == "Annual leave lasts twelve days." == text[best.start : best.end]
    assert rows["l", 1].text == ("leave " * 53).strip() and rows["l", 1].end == 317
    assert {r.query_id: r.answer for r in C.extractive_answers(found).collect()}["q"] == "Based on the most relevant sources: Annual leave lasts twelve days. [1]"


def test_snippets_and_highlights(spark):
    text = "a" * 300 + " quoted words here " + "b" * 300
    rows = spark.createDataFrame([(1, text, 301, 313, "quoted WORDS in a"), (2, "short", None, None, "short"), (3, text, None, None, None)], "id long, text string, s long, e long, question string")
    shown = {r.id: r.x for r in rows.select("id", C.snippet(F.col("text"), F.col("s"), F.col("e")).alias("x")).collect()}
    assert shown[2] == "short" and shown[3] == text[:240] + "..." and shown[1] == "..." + text[187:427] + "..."
    found = C.highlights(rows, ["id"]).orderBy("id", "start").collect()
    assert [(r.id, r.term, r.start, r.end) for r in found] == [(1, "quoted", 301, 307), (1, "words", 308, 313), (2, "short", 0, 5)]


def test_highlights_of_long_questions(spark):
    """A question's terms don't go along with the words of the text."""
    rows = spark.createDataFrame([(1, "Ab, abc abcd. ABC", "abc " + " ".join(f"w{i}" for i in range(3000)))], "id long, text string, question string")
    found = C.highlights(rows, ["id"])
    assert "terms" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert [(r.term, r.start, r.end) for r in found.orderBy("start").collect()] == [("abc", 4, 7), ("abc", 14, 17)]


def test_faithfulness_of_long_answers(spark):
    """Contexts are taken apart once, not once a sentence."""
    answer, context = "Known words are here. Zebras yawn quietly. " * 1000, "known words are here " * 20_000
    rows = spark.createDataFrame([(answer, [context])], "answer string, contexts array<string>")
    start = time.monotonic()
    assert rows.select(C.faithfulness(F.col("answer"), F.col("contexts"))).first()[0] == 0.5
    assert time.monotonic() - start < 60
