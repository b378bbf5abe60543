"""Benchmark decontamination by winnowing.

A span of `window` words that a document shares with a benchmark item has `window - k + 1` k-grams; the least
k-gram name of every such span, the last one among equals, is kept as a fingerprint on both sides. So each shared span has a
fingerprint in common, at one offset, and extending that hit word by word finds the span: none of `window` words or more is
missed. Places with equal words around them are compared once.

The benchmark is a stated query set: it goes to the tasks in blocks of at most `block_bytes` of text, each block
against all documents in one scan without a shuffle: the join of fingerprints is a search in the sorted ones of a block, as
documents have far more of them than the benchmark. With several blocks, one at a time is with the tasks; each row keeps its
hits of the first, and those of the others, which few rows have, are joined to it by doc_id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.bitmap import row_name
from siftwell.llm.shared import stored, tidy
from siftwell.llm.words import NON_WORD, Words, chunks, mix, ranges

WINDOW, K = 13, 7
BLOCK_BYTES = 16 << 20
#: Pairs of a document's and the benchmark's places that are compared at once.
PAIRS = 1 << 20
HITS = "doc_id long, uid long, n_words long, hits array<int>, items array<string>"


def fingerprints(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram names of the least k-gram of every window, the last one among equals, and their word positions."""
    grams, _ = words.windows(k)
    span = window - k + 1
    n = max(0, len(words) - window + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(words.row[:n] == words.row[window - 1 : window - 1 + n])
    least, offset = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        later = grams[j : j + n] <= least
        least[later] = grams[j : j + n][later]
        offset[later] = j
    chosen = np.zeros(len(grams), bool)
    chosen[whole + offset[whole]] = True
    at = np.flatnonzero(chosen)
    return grams[at], at


def contexts(words: Words, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """Names of k-grams with all words that a window with them may have, as far as their text goes."""
    left = np.minimum(window - k, at - words.first[words.row[at]])
    right = np.minimum(window - k, words.first[words.row[at] + 1] - (at + k))
    with np.errstate(over="ignore"):
        return mix(words.spans(at - left, at + k + right) + (left * window + right).astype(np.uint64))


def distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of some columns, in order of the first."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [c[new] for c in columns]


class Benchmark:
    """The items of a block: distinct fingerprints with their contexts in order of name, and names of short items by length. Each
    has the number of a set of items, as many of them have the same items."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW, k: int = K):
        words = Words(texts, NON_WORD, lower=True)
        self.window, self.k, self.ids = window, k, [str(x) for x in ids]
        self.name, self.row = words.name, words.row
        prints, at = fingerprints(words, window, k)
        context = contexts(words, at, window, k)
        order = np.lexsort((at, context, prints))
        prints, context, at = prints[order], context[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (context[1:] != context[:-1])
        self.prints, self.at = prints[new], at[new]
        owners, rows, n = [np.cumsum(new) - 1], [words.row[at]], int(new.sum())
        self.short = {}
        for m in np.unique(words.count[(words.count > 0) & (words.count < window)]):
            short = np.flatnonzero(words.count == m)
            names, own = np.unique(words.windows(int(m))[0][words.first[short]], return_inverse=True)
            self.short[int(m)] = names, n + np.arange(len(names))
            owners.append(n + own)
            rows.append(short)
            n += len(names)
        owner, row = distinct(np.concatenate(owners), np.concatenate(rows))
        self._group(owner, row, n)

    def _group(self, owner: np.ndarray, row: np.ndarray, n: int) -> None:
        """set_of (owner to set) and the items of each set."""
        first, count = np.searchsorted(owner, np.arange(n)), np.bincount(owner, minlength=n)
        with np.errstate(over="ignore"):
            digest = np.add.reduceat(mix(row.astype(np.uint64)), first) if n else np.zeros(0, np.uint64)
        _, one, self.set_of = np.unique(digest, return_index=True, return_inverse=True)
        self.set_size = count[one]
        self.set_first = np.cumsum(self.set_size) - self.set_size
        self.set_items = row[ranges(first[one], self.set_size)]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the hit words, and sorted distinct (row, item) pairs."""
        marks = np.zeros(len(words) + 1, np.int32)
        prints, at = fingerprints(words, self.window, self.k)
        low = np.searchsorted(self.prints, prints, "left")
        count = np.searchsorted(self.prints, prints, "right") - low
        met = count > 0
        at, low, count = at[met], low[met], count[met]
        # equal places count once, so that a text that repeats itself isn't compared with an item that does, place by place
        _, one, own = np.unique(contexts(words, at, self.window, self.k), return_index=True, return_inverse=True)
        left, right, sets = self._extended(words, at[one], low[one], count[one])
        full = right[own] > 0
        np.add.at(marks, at[full] - left[own[full]], 1)
        np.add.at(marks, at[full] + right[own[full]], -1)
        row, place = distinct(words.row[at[full]], own[full])
        first = np.searchsorted(sets[0], place)
        n = np.searchsorted(sets[0], place, "right") - first
        pairs = [distinct(np.repeat(row, n), sets[1][ranges(first, n)])]
        for m, (names, owner) in self.short.items():
            grams, whole = words.windows(m)
            i = np.flatnonzero(whole)
            place = np.minimum(np.searchsorted(names, grams[i]), len(names) - 1)
            same = names[place] == grams[i]
            i, place = i[same], place[same]
            np.add.at(marks, i, 1)
            np.add.at(marks, i + m, -1)
            pairs.append(distinct(words.row[i], self.set_of[owner[place]]))
        rows, owners = (np.concatenate(x) for x in zip(*pairs))
        rows, owners = distinct(rows, owners)
        n = self.set_size[owners]
        return np.cumsum(marks[:-1]) > 0, np.stack(distinct(np.repeat(rows, n), self.set_items[ranges(self.set_first[owners], n)]))

    def _extended(self, words: Words, at: np.ndarray, low: np.ndarray, count: np.ndarray):
        """For each k-gram: how far a window of the benchmark reaches before it and, from its start, after it (0 for no hit), and
        sorted pairs of its place and the number of a set of items."""
        most_left, most_right, pairs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), [np.zeros((2, 0), np.int64)]
        begin, total = 0, np.cumsum(count)
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            place = np.repeat(np.arange(begin, end), count[begin:end])
            own = ranges(low[begin:end], count[begin:end])
            i, j = at[place], self.at[own]
            left, right = np.zeros(len(i), np.int64), np.full(len(i), self.k)
            for step, reach in ((-1, left), (1, right)):
                going = np.ones(len(i), bool)
                for d in range(self.window - self.k):
                    a, b = (i - 1 - d, j - 1 - d) if step < 0 else (i + self.k + d, j + self.k + d)
                    ok = (a >= 0) & (b >= 0) & (a < len(words)) & (b < len(self.name))
                    a, b = np.where(ok, a, 0), np.where(ok, b, 0)
                    going &= ok & (words.name[a] == self.name[b]) & (words.row[a] == words.row[i]) & (self.row[b] == self.row[j])
                    reach += going
            found = left + right >= self.window
            np.maximum.at(most_left, place[found], left[found])
            np.maximum.at(most_right, place[found], right[found])
            pairs.append(np.stack(distinct(place[found], self.set_of[own[found]])))
            begin = end
        return most_left, most_right, np.concatenate(pairs, axis=1)


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW, k: int = K):
    """The benchmark in blocks of about `block_bytes` of text, one on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        table = part.toArrow().sort_by("item_id")
        texts = table["text"].combine_chunks()
        yield Benchmark(table["item_id"].to_pylist(), texts if isinstance(texts, pa.Array) else pa.array([], pa.string()), window, k)


def find_hits(docs: DataFrame, block) -> DataFrame:
    """doc_id, uid (name of doc_id and text), n_words, hits (word positions), items (their ids as text) of each row against a
    broadcast block."""

    def scan(batches):
        own = block.value
        for part in chunks(batches):
            words = Words(part.column(1), NON_WORD, lower=True)
            flags, (rows, items) = own.hits(words)
            at = np.flatnonzero(flags)
            row = words.row[at]
            names = pa.array([own.ids[x] for x in items.tolist()], pa.string())
            edges = np.arange(words.rows + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(words.count.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, edges).astype(np.int32)), pa.array((at - words.first[row]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, edges).astype(np.int32)), names),
                ],
                ["doc_id", "uid", "n_words", "hits", "items"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_name().alias("uid")).mapInArrow(tidy(scan), HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contamination of each document by benchmark items.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item of fewer than
    `window` words, but not none, is one window of its own length. Returns doc_id, uid (`row_name`), n_words, hits (positions of the
    hit words), items (ids with an occurring window, sorted as strings), n_hit, n_items, contaminated
    (n_hit > 0 and a twentieth of n_words at least).

    Null and empty texts have no words and are clean. Items without words match nothing; equal items are each
    listed. An empty benchmark leaves all clean. Other columns of either table are ignored. Every row gives a
    row, repeated ones and those without doc_id too, whatever the number of blocks.
    """
    sc = docs.sparkSession.sparkContext
    out, more = None, None
    for b, block in enumerate(benchmark_blocks(benchmark, block_bytes=block_bytes, window=window, k=k)):
        own = sc.broadcast(block)
        part = find_hits(docs, own)
        if out is None:
            out = part
            continue
        found = stored(part.where(F.size("items") > 0).select("uid", F.lit(b).alias("block"), F.struct("hits", "items").alias("found")))
        own.destroy()
        more = found if more is None else more.unionByName(found)
    if more is not None:
        # equal rows have equal hits in a block: one of them counts for all
        more = more.groupBy("uid", "block").agg(F.first("found").alias("found")).groupBy("uid").agg(F.collect_list("found").alias("found"))
        joined = lambda name: F.concat(name, F.coalesce(F.flatten(f"found.{name}"), F.array().cast(out.schema[name].dataType))).alias(name)
        out = out.join(more, "uid", "left").select("doc_id", "uid", "n_words", F.array_sort(F.array_distinct(joined("hits"))).alias("hits"), joined("items"))
    return out.select(
        "doc_id",
        "uid",
        "n_words",
        "hits",
        F.array_sort("items").alias("items"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        ((F.size("hits") > 0) & (20 * F.size("hits") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
