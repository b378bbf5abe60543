"""Alignment of two tokenizers: byte-level BPE (A) and pieces with byte fallback (B) over the same bytes.

A whole batch of texts is one sequence of bytes, and the texts have offsets in it. The ends of A's and of B's tokens are counted
by byte once; where both have one, the batch is cut into groups. Texts always end in a cut, so sums up to a text's first and last group tell
what is in it. Tokens of a group are linked, each of A with each of B; the number of texts in which two ids are linked is counted over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.bpe import Encoder, cut
from siftwell.llm.exchange import packed, unpacked
from siftwell.llm.shared import stored
from siftwell.llm.units import Pool, pieces
from siftwell.llm.words import chunks, ranges

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, links that are written out at once, and links of a group that is counted by distinct ids.
BYTES, LINKS, LARGE = 1 << 20, 1 << 22, 1 << 16
#: Pairs of ids, the commonest, whose counts are broadcast (13 bytes each); the others are joined by shuffle.
MOST = 1 << 20
#: Pairs that a task holds before it sends their counts on.
HELD = 1 << 22
#: Ids of B stand beyond those of A in the pool of units; BAD is a unit that a tokenizer doesn't give back.
B0, BAD = 1 << 20, 1 << 24
B_BITS = 15
SPACE = "▁"
CHUNKS = "part long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<long>, pairs binary"
ROWS = "part long, at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones for themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Tokens:
    """Bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[ids], self.size[ids])]


class Pair:
    """Both tokenizers, by their definitions. Units are what stands from a space that follows no white space up to the next such: no token of
    either goes beyond one, and each is encoded as in its text."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = sorted((i, t) for t, i in self.a.get_vocab().items())
        special = {t["content"] for t in json.loads(a)["added_tokens"]}
        self.of_a = Tokens([t.encode() if t in special else bytes(letters[c] for c in t) for _, t in vocabulary])
        names = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.of_b = Tokens([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in names])
        self.lone_space = self.b.piece_to_id(SPACE)
        self.pool = Pool(self.encode)

    def _ids(self, texts: list[str]) -> tuple[list, list]:
        """Ids by A of a space and each text, and by B, which puts the space there itself."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = [np.array(ids if t else [self.lone_space], np.int64) for t, ids in zip(texts, self.b.encode(texts, num_threads=1))]
        return a, b

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        own = (" " + text).encode()
        return self.of_a.bytes(a).tobytes() == own == self.of_b.bytes(b).tobytes()

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit (without its space): those of A, then those of B."""
        sizes = 1 + np.asarray(pc.binary_length(pa.array(units, pa.large_string())))
        simple = [i for i, u in enumerate(units) if u and not u[-1].isspace()]
        blocks = [simple[k : k + 1000] for k in range(0, len(simple), 1000)]  # many units are encoded as one text
        texts = [" ".join([units[i] for i in block]) for block in blocks]
        single = sorted(set(range(len(units))) - set(simple))
        own, n_a, n_b, all_a, all_b = ([np.zeros(0, np.int64)] for _ in range(5))
        for block, text, a, b in zip(blocks, texts, *self._ids(texts)):
            if not self._same(text, a, b):
                single += block
                continue
            ends = np.cumsum(sizes[block])
            own.append(np.array(block))
            n_a.append(np.diff(np.searchsorted(np.cumsum(self.of_a.size[a]), ends, "right"), prepend=0))
            n_b.append(np.diff(np.searchsorted(np.cumsum(self.of_b.size[b]), ends, "right"), prepend=0))
            all_a.append(a)
            all_b.append(b)
        texts = [units[i] for i in single]
        for i, text, a, b in zip(single, texts, *self._ids(texts)):
            a, b = (a, b) if self._same(text, a, b) else (np.array([BAD]), b[:0])
            for held, x in ((own, i), (n_a, len(a)), (n_b, len(b)), (all_a, a), (all_b, b)):
                held.append(np.atleast_1d(x))
        own, n_a, n_b, all_a, all_b = map(np.concatenate, (own, n_a, n_b, all_a, all_b))
        count = np.zeros(len(units), np.int64)
        count[own] = n_a + n_b
        start = (np.cumsum(count) - count)[own]
        ids = np.empty(int(count.sum()), np.int64)
        ids[ranges(start, n_a)], ids[ranges(start + n_a, n_b)] = all_a, all_b + B0
        return count, ids

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, unit by unit, and how many each text has."""
        odd = np.asarray(pc.match_substring_regex(column, f"^ |{Encoder.ODD}"))
        plain = np.flatnonzero(~odd)
        code, distinct, edges = pieces(column.take(pa.array(plain)))
        ids, count = self.pool.gather(self.pool.look_up(distinct)[code], edges)
        if not odd.any():
            return ids, count
        units = [re.split(r"(?<=\S) ", t) for t in column.filter(pa.array(odd)).to_pylist()]
        edges = np.cumsum([0, *map(len, units)])
        more, more_count = self.pool.gather(self.pool.look_up([u for us in units for u in us]), edges)
        counts, both = np.concatenate([count, more_count]), np.concatenate([ids, more])
        order, start = np.argsort(np.concatenate([plain, np.flatnonzero(odd)])), np.cumsum(counts) - counts
        return both[ranges(start[order], counts[order])], counts[order]


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers that fit into five, and how many each has."""
    n = np.arange(100_000)
    size = np.maximum(1, np.floor(np.log10(np.maximum(n, 1))).astype(np.int64) + 1)
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(5):
        has = size > k
        out[has, k] = 48 + n[has] // 10 ** (size[has] - 1 - k) % 10
    return out, size


DIGITS, N_DIGITS = _digits()


def summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they stand or the sums of their times."""
    order = None if times is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times[order], first) if len(keys) else times


class Aligned:
    """Texts of a batch: sums by text, the groups as text, and the linked pairs of ids with how often each text links them."""

    def __init__(self, pair: Pair, column: pa.Array):
        rows = len(column)
        flat, count = pair(column)
        row = np.repeat(np.arange(rows), count)
        self.ok = np.asarray(pc.binary_length(column)) > 0
        self.ok[row[flat == BAD]] = False
        keep, of_b = self.ok[row], flat >= B0
        a, a_row = flat[keep & ~of_b].astype(np.int64), row[keep & ~of_b]
        b = flat[keep & of_b].astype(np.int64) - B0
        a_end, b_end = np.cumsum(pair.of_a.size[a]), np.cumsum(pair.of_b.size[b])
        n = int(a_end[-1]) if len(a) else 0
        cuts = np.cumsum(np.bincount(a_end, minlength=n + 1) & np.bincount(b_end, minlength=n + 1))
        a_group, b_group, groups = cuts[a_end - 1], cuts[b_end - 1], int(cuts[-1])
        self.a_count, self.b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        self.a_first, self.b_first = np.cumsum(self.a_count) - self.a_count, np.cumsum(self.b_count) - self.b_count
        self.a, self.b, self.group_row = a, b, a_row[self.a_first]
        edges = np.searchsorted(self.group_row, np.arange(rows + 1))  # first group of each text
        links = self.a_count * self.b_count
        by_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        self.sums = [by_row(self.a_count), by_row(self.b_count), np.diff(edges), by_row(links)]
        self.text, self.text_edges = self._text(a_group, b_group, edges)
        self.keys, self.times = self._pairs(links)

    def _text(self, a_group: np.ndarray, b_group: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups written out, each with a mark after it, and the texts' edges in that."""
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(len(self.a)) + self.b_first[a_group]] = self.a
        ids[np.arange(len(self.b)) + (self.a_first + self.a_count)[b_group]] = self.b
        ends = np.cumsum(self.a_count + self.b_count)
        mark[ends - self.b_count - 1], mark[ends - 1] = ord("|"), ord(";")
        size = N_DIGITS[ids]
        out = DIGITS[ids]
        out[np.arange(len(ids)), size] = mark
        at = np.concatenate([[0], np.cumsum(size + 1)])
        return out[np.arange(6) <= size[:, None]], at[np.concatenate([[0], ends])[edges]]

    def _pairs(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (text, id of A, id of B in one number), ascending, and times."""
        keys, times = [], []
        large = np.flatnonzero(links > LARGE)
        for g in large.tolist():
            own_a, n_a = np.unique(self.a[self.a_first[g] :][: self.a_count[g]], return_counts=True)
            own_b, n_b = np.unique(self.b[self.b_first[g] :][: self.b_count[g]], return_counts=True)
            keys.append((((self.group_row[g] << 31) + (own_a << B_BITS))[:, None] + own_b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
        group = np.flatnonzero(links <= LARGE)
        sums = np.cumsum(links[group])
        at = 0
        while at < len(group):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + LINKS, "right")))
            own = group[at:to]
            n_a, n_b = self.a_count[own], self.b_count[own]
            of = np.repeat(np.arange(len(own)), n_a)  # the group of each token of A
            left = (self.group_row[own][of] << 31) + (self.a[ranges(self.a_first[own], n_a)] << B_BITS)
            right = self.b[ranges(self.b_first[own][of], n_b[of])]
            found = summed(np.repeat(left, n_b[of]) + right)
            keys.append(found[0])
            times.append(found[1])
            at = to
        if len(keys) == 1:
            return keys[0], times[0]
        return summed(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *times]))


def _long(pair: Pair, text: str, digest: bool) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Sums, groups and pairs of one long text, aligned in parts that begin where units do."""
    sums, written, hashed = np.zeros(4, np.int64), [], hashlib.sha256()
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = cut(text, BYTES) if not text[0].isspace() else [text]
    for i, part in enumerate(parts):
        found = Aligned(pair, pa.array([part[1:] if i else part], pa.large_string()))
        if not found.ok[0] and not (i and part == " "):
            return [0] * 4, "", keys[:0], times[:0]
        sums += [s[0] for s in found.sums]
        own = (b";" if i else b"") + found.text[:-1].tobytes()
        hashed.update(own) if digest else written.append(own)
        keys, times = summed(np.concatenate([keys, found.keys]), np.concatenate([times, found.times]))
    return sums.tolist(), hashed.hexdigest() if digest else b"".join(written).decode(), keys, times


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, digest: bool = False) -> DataFrame:
    """CHUNKS of documents with their sums, groups (`digest`: their sha256 instead) and pairs of linked ids."""
    import public_tokenizers

    with open(a or public_tokenizers.path(A)) as file:
        definition = file.read()
    with open(b or public_tokenizers.path(B), "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))  # two vocabularies

    def scan(batches):
        pair, number = None, TaskContext.get().partitionId() << 32
        for part in chunks(batches, size=BYTES):
            pair = pair or Pair(*shared.value)
            column = part.column(1).cast(pa.large_string()).fill_null("")
            if len(column) == 1 and column.nbytes > 2 * BYTES:
                sums, groups, keys, times = _long(pair, column[0].as_py(), digest)
                sums, groups, n_pairs = [[x] for x in sums], [groups], np.array([len(keys)])
            else:
                found = Aligned(pair, column)
                sums, keys, times, data = found.sums, found.keys, found.times, found.text.tobytes()
                each = [data[x : max(x, y - 1)] for x, y in zip(found.text_edges.tolist(), found.text_edges[1:].tolist())]
                groups = [hashlib.sha256(x).hexdigest() if digest and x else x.decode() for x in each]
                n_pairs = np.diff(np.searchsorted(keys, np.arange(len(column) + 1) << 31))
            delta = np.diff(keys & 0x7FFFFFFF, prepend=0)
            first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
            delta[first] = keys[first] & 0x7FFFFFFF
            data = packed([delta.astype(np.uint32), times.astype(np.uint32)]) if len(keys) else b""
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (part.column(0).to_pylist(), *(list(s) for s in sums))]
            columns = [pa.array([number]), *lists, pa.array([groups], pa.list_(pa.string())), pa.array([n_pairs.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, CHUNKS)


def _unpacked(n_pairs, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, pair and times."""
    delta, times = unpacked(data, ["<u4", "<u4"]) if data else (np.zeros(0, np.uint32),) * 2
    n = np.asarray(n_pairs, np.int64)
    sums = np.cumsum(delta.astype(np.int64))
    before = np.concatenate([[0], sums])[np.cumsum(n) - n]
    return np.repeat(np.arange(len(n)), n), sums - np.repeat(before, n), times.astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair (id of A << 15 | id of B), n (documents that link them) and best (whether no other pair of that id of A has more)."""

    def scan(batches):
        held, size = [], 0

        def counted():
            keys, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            return keys, n

        for batch in batches:
            for n_pairs, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, pair, _ = _unpacked(n_pairs, data)
                held.append(summed(pair))
                size += len(held[-1][0])
                if size >= HELD:
                    held = [counted()]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, counted())], ["pair", "n"])

    pairs = found.select("n_pairs", "pairs").mapInArrow(scan, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("a", F.shiftright("pair", B_BITS)))
    most = F.broadcast(pairs.groupBy("a").agg(F.max("n").alias("most")))  # a row an id of A at most
    return pairs.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(found: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """ROWS of CHUNKS with n_best and count_sum. The counts of at most `most` pairs, the commonest, are broadcast; what documents have of other
    pairs meets their counts in a shuffle, where each has fewer rows than any of those."""
    level = F.floor(F.log2("n"))
    left, least = most, 1
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # 64 rows at most
        if r["count"] > left:
            least = 1 << (r.level + 1)
            break
        left -= r["count"]
    table = pairs.where(F.col("n") >= least).select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
    keys, n = np.asarray(table["pair"]).astype(np.uint32), np.asarray(table["n"])
    order = np.argsort(keys)
    shared = found.sparkSession.sparkContext.broadcast((keys[order], np.abs(n[order]), n[order] < 0))

    def looked_up(batch, k):
        keys, n, best = shared.value
        at, pair, times = _unpacked(batch.column("n_pairs")[k].as_py(), batch.column("pairs")[k].as_py())
        place = np.minimum(np.searchsorted(keys, pair.astype(np.uint32)), max(0, len(keys) - 1))
        known = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
        return at, pair, times, place, known, n, best

    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at, _, times, place, known, n, best = looked_up(batch, k)
                row = batch.slice(k, 1)
                size = len(row.column("doc_ids")[0])
                at, place, times = at[known], place[known], times[known]
                sums = np.zeros((2, size), np.int64)
                np.add.at(sums[0], at[best[place]], times[best[place]])
                np.add.at(sums[1], at, times * n[place])
                own = [row.column(c)[0].values for c in ("doc_ids", *SUMS, "groups")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, row.column("part")[0].as_py())), pa.array(np.arange(size)), *own, *map(pa.array, sums)], [c.split()[0] for c in ROWS.split(", ")])

    def others(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at, pair, times, _, known, *_ = looked_up(batch, k)
                at, pair, times = at[~known], pair[~known], times[~known]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("part")[k].as_py())), pa.array(at), pa.array(pair), pa.array(times)], ["part", "at", "pair", "times"])

    out = found.mapInArrow(scan, ROWS)
    if least > 1:
        more = found.select("part", "n_pairs", "pairs").mapInArrow(others, "part long, at long, pair long, times long").join(pairs, "pair")
        more = more.groupBy("part", "at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        out = out.join(more, ["part", "at"], "left").select("part", "at", "doc_id", *SUMS, "groups", add("n_best", "more_best"), add("count_sum", "more_sum"))
    return out


def align(docs: DataFrame, a: str | None = None, b: str | None = None, digest: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2`, or its sha256 with `digest`) of each row.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty string. Every row is a
    document, repeated ones and those without doc_id too. Equal counts are all best. Other columns are ignored; an empty
    table gives no rows. A text of more than some two megabytes is aligned in parts.
    """
    found = stored(aligned(docs, a, b, digest))
    return with_counts(found, stored(pair_counts(found)), most).drop("part", "at")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select("doc_id", *SUMS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
