"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

A shard's postings stand in one sequence: term by term, and of a term by descending impact. A wavelet tree over the documents of that
sequence (kept level by level, as a wavelet matrix) holds both orders: at the top a term's range is in order of impact, on the
way down each node halves the documents, which are numbered by doc_id, and keeps the order of impact. So the first posting of a
term's range in a node has the highest impact of that term in the node's documents, and the sum of these over the terms of a query bounds
the scores of all of them. Nodes are opened by descending bound, the ranges of all terms together, until no node's bound reaches the k-th score:
the top k is exact.

Shards are made where the documents lie, without an exchange; a task carries the k-th score from shard to shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import scratch, shared_dir, stored
from siftwell.llm.url_rules import ASCII_LOWER, ASCII_UPPER
from siftwell.llm.words import NON_WORD, Words, chunks

TOP = 20
#: Documents and bytes of text after which a shard is closed, and its postings at most when all terms are indexed.
SHARD_DOCS, SHARD_BYTES, SHARD_POSTINGS = 1 << 12, 32 << 20, 1 << 22
#: Nodes that are opened together; bytes of queries asked together; asked terms up to which only those are indexed.
OPEN, BLOCK_BYTES, ASKED = 32, 1 << 20, 1 << 20
#: Values of impact that a level's bounds are rounded up to.
STEPS = 256
POSTINGS = "ids binary, lengths binary, terms binary, counts binary, docs binary, tfs binary, n long, total long"
TREES = "ids binary, terms binary, counts binary, words binary, codes binary, steps binary, leaves binary"
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _row(schema: str, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values], _names(schema))


def _grouped(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of row, and how often each stands."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return row[first], term[first], np.diff(np.append(first, len(row)))


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.size, self.postings = [], [], [], 0, 0

    def add(self, ids: np.ndarray, words: Words, asked: np.ndarray | None) -> None:
        base = sum(map(len, self.ids))
        some = np.flatnonzero(words.count)  # documents with a term
        number = np.cumsum(words.count > 0) - 1
        row, term = words.row, words.name
        if asked is not None:
            at = np.searchsorted(asked, term)
            known = np.zeros(len(term), bool) if not len(asked) else asked[np.minimum(at, len(asked) - 1)] == term
            row, term = row[known], term[known]
        row, term, tf = _grouped(row, term)
        self.ids.append(ids[some])
        self.lengths.append(words.count[some].astype(np.int64))
        self.parts.append((base + number[row], term, tf))
        self.size += int(words.offsets[-1])
        self.postings += len(row)

    def full(self) -> bool:
        return sum(map(len, self.ids)) >= SHARD_DOCS or self.size >= SHARD_BYTES or self.postings >= SHARD_POSTINGS

    def batch(self) -> pa.RecordBatch:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        doc, term, tf = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        by = np.lexsort((place[doc], term))
        doc, term, tf = place[doc][by], term[by], tf[by]
        first = np.flatnonzero(np.diff(term, prepend=term[:1] + _U(1))) if len(term) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(term)))
        return _row(POSTINGS, [ids[order], lengths[order], term[first], counts.astype(np.int64), doc.astype(np.int32), tf.astype(np.int64), len(ids), int(lengths.sum())])


def postings(docs: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """POSTINGS of shards: ids (ascending) and lengths in terms of the documents, the terms by name with their numbers of documents, and
    term by term the documents by number, with their occurrences. Only `asked` terms (sorted names) get postings, if given; lengths count all."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def scan(batches):
        shard = _Shard()
        for part in chunks(batches):
            ids = np.asarray(part.column(0).fill_null(NO_ID))
            shard.add(ids, Words(part.column(1), NON_WORD, lower=True), shared.value)
            if shard.full():
                yield shard.batch()
                shard = _Shard()
        if shard.size:
            yield shard.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, POSTINGS)


class Tree:
    """The dual-sorted wavelet tree of a shard."""

    def __init__(self, ids, terms, counts, words, codes, steps, leaves):
        self.ids, self.terms, self.steps, self.leaves = ids, terms, steps, leaves
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.size, self.bits = len(leaves), max(1, (len(ids) - 1).bit_length())
        self.words, self.codes = words, codes
        self.width = self.size // 64 + 1
        each = np.bitwise_count(words).reshape(self.bits, self.width).astype(np.int64)
        self.ranks = (np.cumsum(each, axis=1) - each).ravel()
        self.zeros = self.size - each.sum(axis=1)

    @classmethod
    def build(cls, ids: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> Tree:
        """docs and impacts: of the postings, term by term."""
        term = np.repeat(np.arange(len(terms)), counts)
        order = np.lexsort((docs, -impacts, term))
        doc, impact = docs[order].astype(np.int64), impacts[order]
        found = np.unique(impact)
        steps = found[np.unique(np.linspace(0, len(found) - 1, STEPS).round().astype(np.int64))] if len(found) else np.zeros(1, np.int64)
        code = np.searchsorted(steps, impact).astype(np.uint8)  # of the least step that isn't below
        bits, width = max(1, (len(ids) - 1).bit_length()), len(doc) // 64 + 1
        words, codes = np.zeros((bits, width), np.uint64), np.empty((bits, len(doc)), np.uint8)
        for level in range(bits):
            codes[level] = code
            one = (doc >> (bits - 1 - level)) & 1
            words[level].view(np.uint8)[: (len(doc) + 7) // 8] = np.packbits(one.astype(np.uint8), bitorder="little")
            order = np.argsort(one, kind="stable")
            doc, impact, code = doc[order], impact[order], code[order]
        return cls(ids, terms, counts, words.ravel(), codes.ravel(), steps, impact)

    def parts(self) -> list[np.ndarray]:
        return [self.ids, self.terms, np.diff(self.starts), self.words, self.codes, self.steps.astype(np.int64), self.leaves.astype(np.int64)]

    @classmethod
    def read(cls, row: dict) -> Tree:
        kinds = {"ids": np.int64, "terms": np.uint64, "counts": np.int64, "words": np.uint64, "codes": np.uint8, "steps": np.int64, "leaves": np.int64}
        return cls(*(np.frombuffer(row[c], kinds[c]) for c in _names(TREES)))

    def ranges(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of each term at the top; empty for terms that the shard doesn't have."""
        at = np.minimum(np.searchsorted(self.terms, names), max(0, len(self.terms) - 1))
        has = self.terms[at] == names if len(self.terms) else np.zeros(len(names), bool)
        return np.where(has, self.starts[at], 0), np.where(has, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before places of a level."""
        word = level * self.width + (at >> 6)
        return self.ranks[word] + np.bitwise_count(self.words[word] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1)))

    def opened(self, level: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms' ranges in both children of each node: first the lower halves of the documents, then the upper ones."""
        level = level[:, None]
        a, b = self.ones(level, starts), self.ones(level, ends)
        zeros = self.zeros[level]
        return np.concatenate([starts - a, zeros + a]), np.concatenate([ends - b, zeros + b])

    def bounds(self, level: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each node the most that any of its documents scores; at the leaves that is the score."""
        some, leaf = starts < ends, level == self.bits
        out = np.zeros(starts.shape, np.int64)
        inner = some & ~leaf[:, None]
        out[inner] = self.steps[self.codes[(level[:, None] * self.size + starts)[inner]]]
        last = some & leaf[:, None]
        out[last] = self.leaves[starts[last]]
        return (out * weights).sum(axis=1)

    def search(self, names: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the shard's documents that are among the best."""
        start, end = self.ranges(names)
        has = (start < end) & (weights > 0)
        if not has.any():
            return
        weights, starts, ends = weights[has], start[has][None], end[has][None]
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.bounds(level, starts, ends, weights)
        while True:
            first = self.ids[np.minimum(prefix << (self.bits - level), len(self.ids) - 1)]  # the least doc_id that the node may have
            keep = np.flatnonzero(best.reached(bound, first))
            if not len(keep):
                return
            if len(keep) > OPEN:
                keep = keep[np.argsort(-bound[keep], kind="stable")]
            take, rest = keep[:OPEN], keep[OPEN:]
            s, e = self.opened(level[take], starts[take], ends[take])
            own = np.tile(level[take] + 1, 2)
            below = np.concatenate([2 * prefix[take], 2 * prefix[take] + 1])
            sums = self.bounds(own, s, e, weights)
            leaf = (own == self.bits) & (sums > 0)
            best.add(sums[leaf], self.ids[below[leaf]])
            more = (own < self.bits) & (sums > 0)
            level, prefix, bound = np.concatenate([level[rest], own[more]]), np.concatenate([prefix[rest], below[more]]), np.concatenate([bound[rest], sums[more]])
            starts, ends = np.concatenate([starts[rest], s[more]]), np.concatenate([ends[rest], e[more]])


class Best:
    """The k best (score, doc_id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reached(self, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether something of that score and id would be taken up."""
        if len(self.scores) < self.k:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (ids <= self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class Index:
    """An index of all documents with a term, in a folder: `trees` (TREES) and the corpus's number of documents and of terms."""

    def __init__(self, trees: DataFrame, n: int, total: int):
        self.trees, self.n, self.total = trees, n, total

    def frequencies(self, names: np.ndarray) -> np.ndarray:
        """In how many documents each of the terms is."""
        shared = self.trees.sparkSession.sparkContext.broadcast(names)

        def scan(batches):
            asked = shared.value
            total = np.zeros(len(asked), np.int64)
            for batch in batches:
                for terms, counts in zip(batch.column(0), batch.column(1)):
                    terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                    at = np.searchsorted(asked, terms)
                    met = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == terms) if len(asked) else at[:0]
                    total[at[met]] += counts[met]
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["at", "df"])

        found = self.trees.select("terms", "counts").mapInArrow(scan, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        out = np.zeros(len(names), np.int64)
        out[np.asarray(found["at"])] = np.asarray(found["df"])  # a row an asked term at most
        return out

    def weights(self, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.n + 2) / (2 * df + 1))).astype(np.int64)

    def top(self, block: Queries, k: int) -> DataFrame:
        """item, item_id, doc_id and score of the k best of each query in each task's shards."""
        df = self.frequencies(block.terms)
        weight = np.where(df > 0, self.weights(df), 0)
        shared = self.trees.sparkSession.sparkContext.broadcast((block.queries(weight), k))

        def scan(batches):
            (items, queries), most = shared.value
            best = [Best(most) for _ in queries]
            for batch in batches:
                for k in range(batch.num_rows):
                    tree = Tree.read(batch.slice(k, 1).to_pylist()[0])
                    for own, (names, weights) in zip(best, queries):
                        tree.search(names, weights, own)
            item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
            ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([b.ids for b in best], [b.scores for b in best]))
            columns = [pa.array(items[0][item] if len(item) else item, pa.int64()), pa.array([items[1][i] for i in item.tolist()], pa.string()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

        return self.trees.mapInArrow(scan, "item long, item_id string, doc_id long, score long")


def build(docs: DataFrame, asked: np.ndarray | None = None) -> Index:
    """Two passes: postings of shards where the documents lie, then, as impacts need the corpus's totals, a tree a shard."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    with scratch(spark):
        shards = stored(postings(docs, asked))
        totals = shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()

        def scan(batches):
            n, total = totals
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    ids, lengths, counts, tfs = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "counts", "tfs"))
                    docs, terms = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["terms"], np.uint64)
                    if len(ids):
                        m = 75 + 25 * lengths * n // total
                        yield _row(TREES, Tree.build(ids, terms, counts, docs, 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs])).parts())

        trees = stored(shards.mapInArrow(scan, TREES), path)
    return Index(trees, *totals)


class Queries:
    """A block of queries: their rows, and their terms by name."""

    def __init__(self, ids: list, texts: pa.Array, first: int):
        words = Words(texts, NON_WORD, lower=True)
        self.ids, self.numbers = ids, first + np.arange(len(ids))
        self.terms, term = np.unique(words.name, return_inverse=True)
        self.row, self.term, self.times = _grouped(words.row, term)

    def queries(self, weight: np.ndarray):
        """Numbers and ids of the queries, and for each its terms and what an impact of one counts for."""
        edges = np.searchsorted(self.row, np.arange(len(self.ids) + 1)).tolist()
        own = [(self.terms[self.term[a:b]], weight[self.term[a:b]] * self.times[a:b]) for a, b in zip(edges, edges[1:])]
        return (self.numbers, self.ids), own


def query_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The queries in blocks of about `block_bytes` of text, one on the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n, first = max(1, -(-size // block_bytes)), 0
    for b in range(n):
        table = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)).toArrow()
        texts = pa.concat_arrays(table["text"].chunks) if table.num_rows else pa.array([], pa.string())
        yield Queries(table["item_id"].to_pylist(), texts, first)
        first += table.num_rows


def asked_terms(items: DataFrame, most: int = ASKED) -> np.ndarray | None:
    """The queries' distinct terms by name, sorted; None if they are more than `most`."""

    def scan(batches):
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(part.column(0), NON_WORD, lower=True).name).view(np.int64))], ["term"])

    terms = items.select("text").mapInArrow(scan, "term long").distinct().limit(most + 1).toArrow()["term"]
    return None if len(terms) > most else np.sort(np.asarray(terms, np.int64).view(np.uint64))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, index: Index | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each row of `items`, all with a score above 0.

    Without an `index` one is made of the terms that are asked for; lengths and totals count all terms, and all terms are indexed if more than ASKED are
    asked for. Null and empty texts have no terms: such a document is never found, such an item finds nothing. Every row is a
    document or an item of its own, repeated ones too. Ties go by ascending doc_id, null ids last. Other columns of either table are
    ignored. Empty tables give no rows. A long text is split into words piece by piece and is one document of its shard.
    """
    items = items.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = items.schema["item_id"].dataType
    items = items.withColumn("item_id", F.col("item_id").cast("string"))
    index = index or build(docs, asked_terms(items))
    found = None
    for block in query_blocks(items, block_bytes):
        part = stored(index.top(block, k))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, {_TERMS} AS term FROM documents
), asked AS (
  SELECT item_id, {_TERMS} AS term FROM benchmark
), times AS (
  SELECT item_id, term, count(*) AS q FROM asked GROUP BY item_id, term
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term
), ms AS (
  SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM sizes, totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM times JOIN weights USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
