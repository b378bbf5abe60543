import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import stems as S
from siftwell.operators import fulltext as X

# words and stems as published with the rules
SAMPLE = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistently consist, consists consist, consolation consol, consolatory consolatori,
console consol, consolidate consolid, consolidated consolid, consolidating consolid, consolingly consol, consonant conson, consort consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirators conspir,
constable constabl, constancy constanc, knack knack, knackeries knackeri, knavish knavish, kneaded knead, kneel kneel, knees knee, knife knife, knightly knight, knitted knit, knitting knit, knives knive, knockers knocker, knots knot,
generate generat, generously generous, skies sky, dying die, news news, inning inning, proceed proceed, flies fli, ties tie, tied tie, gas gas, this this, kiwis kiwi, hopping hop, hoping hope, luxuriating luxuri,
agreed agre, feed feed, happy happi, by by, say say, relational relat, conditional condit, rationalize ration, electricity electr, hopefulness hope, goodness good, adjustment adjust, adoption adopt, rate rate, controlling control, roll roll,
yes yes, youth youth, boy boy, boyish boyish, bed bed, shed shed, caresses caress, ponies poni, analogous analog, apology apolog, vietnamization vietnam, sensibility sensibl, predicate predic, formative format
"""


@pytest.mark.parametrize("pair", SAMPLE.replace("\n", " ").split(","))
def test_stems(pair):
    word, want = pair.split()
    assert S.stem(word) == want


def test_arrays(spark):
    rows = spark.createDataFrame([(1, ["running", None, "cats"]), (2, []), (3, None), (4, ["cats"])], "i int, w array<string>")
    assert [r.s for r in rows.select("i", S.stems(F.col("w")).alias("s")).orderBy("i").collect()] == [["run", None, "cat"], [], None, ["cat"]]


def covers(entries, terms):
    """By trying all stretches: those that hold all terms and none of whose shorter ones does."""
    full = [(a, b) for a in range(len(entries)) for b in range(a, len(entries)) if {t for _, t in entries[a : b + 1]} == terms]
    return [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]


def brute(docs, questions, k):
    split = lambda t: [None if w in S.STOPWORDS else S.stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
    out = []
    for q, text in questions:
        asked = {s for s in split(text) if s}
        scored = []
        for d, t in docs:
            entries = [(i + 1, s) for i, s in enumerate(split(t)) if s in asked]
            if asked and {s for _, s in entries} == asked:
                score = sum(0.1 / (1 + entries[b][0] - entries[a][0] - (b - a)) for a, b in covers(entries, asked))
                scored.append((-round(score, 6), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


QUESTIONS = [(1, "the running cats"), (2, "Cats"), (3, "of the"), (4, ""), (5, None), (6, "cat dog bird"), (7, "unknown cat"), (8, "dogs, dog and DOGGED cats")]


@pytest.mark.parametrize("stored", [False, True])
def test_like_all_stretches(spark, stored, tmp_path):
    rng = random.Random(3)
    words = ["cat", "cats", "run", "running", "the", "of", "dog", "dogs", "bird", "birds", "x1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(150)] + [(500, None), (501, ""), (502, "Cats! the-runner ran; cats run")]
    index = X.PositionalIndex(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}" if stored else None)
    found = X.full_text(index, spark.createDataFrame(QUESTIONS, "query_id long, question string"), 7)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in found.collect()) == brute(docs, QUESTIONS, 7)


def test_access_and_many_stems(spark, monkeypatch):
    monkeypatch.setattr(X, "FILTER_STEMS", 1)
    docs = [(1, "cat dog"), (2, "cat x dog"), (3, "dog cat")]
    index = X.PositionalIndex(spark.createDataFrame(docs, "doc_id long, text string"))
    questions = spark.createDataFrame([(1, "cats dogs")], "query_id long, question string")
    allowed = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert [(r.doc_id, r.score) for r in X.full_text(index, questions, 5, allowed).orderBy("rank").collect()] == [(3, 0.1), (2, 0.05)]
