"""English full text: stems with positions, all of a question's stems, ranked by how close together they stand (cover density).

A text's covers are the shortest stretches that hold all stems of the question, none within another. Each counts WEIGHT, divided by one more than
the words in it that aren't the question's. Positions count all words, stop words too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.stems import positions, stems
from siftwell.functions.text import tokens
from siftwell.operators.ranking import hint, top_k

#: Fixed value: what a word of plain text weighs.
WEIGHT = 0.1
#: Parts that a stem's postings are dealt to, so that a very common one isn't one task's; stems up to which postings are read by a filter.
SALTS, FILTER_STEMS = 16, 1000


def text_stems(text: Column) -> Column:
    """The stem of each word in order; stop words stand as nulls."""
    return stems(tokens(F.coalesce(text, F.lit(""))), stopwords=False)


class PositionalIndex:
    """doc_id, stem, positions (ascending, from 1) of a corpus, a row a stem and document.

    Written with a path, the postings lie in order of stem in files of their own, so that a question reads the row groups of its stems. Postings are made
    in the row of their document and exchanged once.
    """

    def __init__(self, docs: DataFrame, path: str | None = None):
        found = docs.select("doc_id", F.explode(positions(tokens(F.coalesce("text", F.lit(""))))).alias("x"))
        self.postings = found.select("doc_id", "x.stem", "x.positions")
        if path:
            salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
            self.postings.repartition("stem", salt).sortWithinPartitions("stem", "doc_id").write.mode("overwrite").parquet(f"{path}/positions")
            self.postings = docs.sparkSession.read.parquet(f"{path}/positions")

    def of_stems(self, asked: DataFrame) -> DataFrame:
        few = [r.stem for r in asked.select("stem").distinct().limit(FILTER_STEMS + 1).collect()]
        return self.postings.where(F.col("stem").isin(few)) if len(few) <= FILTER_STEMS else self.postings.join(asked.select("stem").distinct(), "stem", "left_semi")


def question_stems(questions: DataFrame) -> DataFrame:
    """query_id, stem: a question's distinct stems, without stop words."""
    return questions.select("query_id", F.explode(text_stems(F.col("question"))).alias("stem")).where("stem IS NOT NULL").distinct()


def density(places: Column, n: Column) -> Column:
    """Cover density of places (ascending array of position and term, a number from 0) of n terms.

    Going through the places, the last one of each term is kept. A cover ends where the earliest of these has moved past the start of the last cover.
    """
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("at"), F.lit(0.0).cast("double").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda old, i: F.when(i == x["term"], s["at"]).otherwise(old))
        first = F.array_min(last)
        between = x["position"] - F.get(places, first)["position"]
        noise = between - (s["at"] - first)
        more = F.when(first > s["begun"], WEIGHT / (1 + noise)).otherwise(0.0).cast("double")
        return F.struct(last.alias("last"), F.greatest(s["begun"], first).alias("begun"), (s["at"] + 1).alias("at"), (s["sum"] + more).alias("sum"))

    return F.aggregate(places, start, step)["sum"]


def full_text(index: PositionalIndex, questions: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score of texts that have all stems of a question (query_id, question); `allowed` (doc_id) is applied before the ranking.

    The stem that fewest texts have gives the candidates; postings of the others are kept only for these. Questions without stems find nothing.
    """
    sized, asked = hint(questions), question_stems(questions)
    found = index.of_stems(asked)
    if allowed is not None:
        found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
    df = found.groupBy("stem").agg(F.count("*").alias("df"))
    wanted = asked.join(sized(df), "stem", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("df", "stem"))), lambda x: x["stem"])
    per = wanted.groupBy("query_id").agg(numbered.alias("stems"), F.min("df").alias("least")).where("least > 0")
    terms = per.select("query_id", F.size("stems").alias("n"), F.posexplode("stems").alias("term", "stem"))
    first = found.select("stem", "doc_id").join(sized(terms.where("term = 0")), "stem").select("query_id", "doc_id")
    hits = found.join(sized(terms), "stem").join(first, ["query_id", "doc_id"], "left_semi")
    places = F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("position"), F.col("term").alias("term"))))))
    both = hits.groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("met"), places.alias("places")).where("met = n")
    scored = both.select("query_id", "doc_id", F.round(density(F.col("places"), F.col("n")), 6).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "doc_id", "score")
