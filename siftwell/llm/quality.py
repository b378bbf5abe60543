"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of all vote patterns
estimates every rule's accuracy and the share of good documents; a document is kept if its posterior probability of
being good is one half at least. No single rule decides, except for the base rules of `op4`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.shared import stored
from siftwell.llm.words import SPACE, Words, chunks

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = np.ones(256, bool)  # bytes that begin a code point
_POINT[0x80:0xC0] = False


def _repeated(row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, name): the index of its group, and whether it is the group's first."""
    order = np.lexsort((name, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (name[order][1:] != name[order][:-1])
    group, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    group[order] = np.cumsum(new) - 1
    first[order[new]] = True  # lexsort is stable
    return group, first


def text_stats(column: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for each text."""
    words = Words(column, SPACE)
    edges = words.offsets

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # lines with a word, named by their bytes; a line is one "word" when only \n separates
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = Words(column, newline)
    has_word = np.zeros(len(lines), bool)
    if len(words):
        has_word[np.searchsorted(lines.start, words.start, "right") - 1] = True
    row, name = lines.row[has_word], lines.name[has_word]
    _, first = _repeated(row, name)
    dup = np.bincount(row[~first], minlength=words.rows)
    names, whole = words.windows(3)
    at = np.flatnonzero(whole)
    group, _ = _repeated(words.row[at], names[at])
    often = at[np.bincount(group)[group] > 1] if len(at) else at
    marked = np.zeros(len(words), bool)
    for j in range(3):
        marked[often + j] = True
    return [
        words.count.astype(np.int64),
        per_text(in_word & _POINT[words.data]),
        per_text(_SYMBOL[words.data]),
        np.bincount(row, minlength=words.rows),
        dup,
        np.bincount(words.row[marked], minlength=words.rows),
    ]


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every document in one scan. Null and empty texts have zeros."""

    def scan(batches):
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in text_stats(part.column(1)))], names=["doc_id", *(x.split()[0] for x in STATS.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the columns of STATS. A document without words gets bad votes where a ratio is undefined."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    mean = F.try_divide(F.col("word_chars"), n)
    symbols, lines = F.try_divide(F.col("n_symbols"), n), F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    repeats = F.try_divide(F.col("n_repeat_words"), n)
    return {
        "length": _vote(n < 50, n >= 100),
        "word_size": _vote(~some | (mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 10)),
        "symbols": _vote(~some | (symbols > 0.1), symbols <= 0.02),
        "repeated_lines": _vote(~some | (lines > 0.3), lines <= 0.1),
        "repeated_words": _vote(~some | (repeats > 0.3), repeats <= 0.15),
    }


class VoteModel:
    """Two classes; P(vote | class) of each rule, and the share of good documents."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0):
        """EM over distinct vote patterns (at most 3 ** rules of them) and how often each occurs."""
        rules = patterns.shape[1]
        self.share, self.rate = 0.5, np.full((2, rules, 3), 1 / 3)
        one_hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
        good = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))  # begins with the soft majority
        for _ in range(rounds):
            weight = np.stack([(1 - good) * counts, good * counts])
            # a vote is right with the rule's accuracy in both classes; how often it abstains may differ by class
            rate = np.einsum("cp,prv->crv", weight, one_hot) + smooth
            rate /= rate.sum(2, keepdims=True)
            right = rate[0, :, 0] * weight[0].sum() + rate[1, :, 2] * weight[1].sum()
            wrong = rate[0, :, 2] * weight[0].sum() + rate[1, :, 0] * weight[1].sum()
            self.accuracy = np.clip(right / np.maximum(right + wrong, 1e-9), 0.5, 1 - 1e-6)
            spoken = 1 - rate[:, :, 1]
            rate[0, :, 0], rate[0, :, 2] = spoken[0] * self.accuracy, spoken[0] * (1 - self.accuracy)
            rate[1, :, 2], rate[1, :, 0] = spoken[1] * self.accuracy, spoken[1] * (1 - self.accuracy)
            self.rate, self.share = rate, float(np.clip((weight[1].sum() + smooth) / (counts.sum() + 2 * smooth), 1e-6, 1 - 1e-6))
            good = self.posterior(patterns)

    def log_odds(self) -> tuple[float, np.ndarray]:
        """The prior's, and those that each vote of each rule adds."""
        return float(np.log(self.share / (1 - self.share))), np.log(np.maximum(self.rate[1], 1e-12)) - np.log(np.maximum(self.rate[0], 1e-12))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        prior, by_vote = self.log_odds()
        odds = prior + sum(by_vote[r, patterns[:, r] + 1] for r in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_votes(votes: DataFrame, names: list[str]) -> VoteModel:
    """The model of all rows' votes; only counts of patterns reach the driver."""
    rows = votes.groupBy(*names).count().orderBy(*names).collect()
    patterns = np.array([[r[c] for c in names] for r in rows], dtype=int).reshape(len(rows), len(names))
    return VoteModel(patterns, np.array([r["count"] for r in rows], dtype=float))


def posterior(model: VoteModel, names: list[str]) -> Column:
    prior, by_vote = model.log_odds()
    odds = F.lit(prior)
    for r, name in enumerate(names):
        bad, none, good = map(float, by_vote[r])
        odds = odds + F.when(F.col(name) == 1, good).when(F.col(name) == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judge(stats: DataFrame, own_rules: dict[str, Column] | None = None) -> DataFrame:
    """Adds a vote column for each rule and `p_good`. An empty table gives an empty result."""
    own_rules = own_rules or rules()
    votes = stats.select("*", *[v.alias(f"vote_{k}") for k, v in own_rules.items()])
    names = [f"vote_{k}" for k in own_rules]
    return votes.withColumn("p_good", posterior(fit_votes(votes, names), names))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go; of the others those with a posterior of one half at least are kept."""
    stats = stored(with_stats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = judge(stats).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")
