"""Byte-level BPE encoding and decoding.

Distinct pre-tokens are encoded together: rows of token ids, padded to their length bucket, in which every row merges its
leftmost pair of least rank each round. Ranks of pairs come from a hashed table; a merge takes one column out of each
row, so the matrix is compacted to one column less and without its finished rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.shared import small_batches, tidy
from siftwell.llm.units import Pool, pieces
from siftwell.llm.words import chunks, mix, ranges, text_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Elements of a matrix at most; rows of more bytes than LONG are merged one by one with a heap.
CELLS, LONG = 1 << 20, 2048
#: Bytes of text a worker encodes at once, and ids it decodes at once.
BYTES, IDS = 1 << 19, 1 << 17


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from lines of "base64 rank"."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Merges:
    """Token bytes, and a hashed table from pairs of tokens to the token they make."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        pairs = [(rank[t[:k]], rank[t[k:]], i) for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.of_byte = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        key = (left << 32 | right).astype(np.uint64)
        self.bits = max(10, int(np.ceil(np.log2(4 * len(key) + 1))))
        self.key = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        slot, self.probes = self._slot(key), 0
        while len(key):  # each free slot goes to one of those that want it; the others move on
            self.probes += 1
            wants = np.flatnonzero(self.made[slot] == NONE)
            _, first = np.unique(slot[wants], return_index=True)
            won = wants[first]
            self.key[slot[won]], self.made[slot[won]] = key[won], made[won]
            left_over = np.ones(len(key), bool)
            left_over[won] = False
            key, made, slot = key[left_over], made[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes; NONE for no token and beside padding (-1)."""
        key = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64)
        slot = self._slot(key)
        out = np.where(self.key[slot] == key, self.made[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (left >= 0) & (right >= 0) & (self.made[slot] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            same = self.key[at] == key[open_]
            out[open_[same]] = self.made[at[same]]
            open_ = open_[~same & (self.made[at] != NONE)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word, each merged by itself: counts, and the ids one word after the other."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        start = np.cumsum(size) - size
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, ids
        width = 1
        short = np.minimum(size, LONG + 1)
        while width < 2 * LONG:
            rows = np.flatnonzero((short <= width) & (short > width // 2 if width > 1 else short <= 1) & (size <= LONG))
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                found += self._merge_rows(data, start, size, rows[k : k + step], width)
            width *= 2
        for w in np.flatnonzero(size > LONG).tolist():
            ids = self._merge_long(data[start[w] : start[w] + size[w]].tolist())
            found.append((np.array([w]), np.array([len(ids)]), np.array(ids, np.int32)))
        count = np.zeros(len(words), np.int64)
        for w, n, _ in found:
            count[w] = n
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for w, n, ids in found:
            out[ranges(begin[w], n)] = ids
        return count, out

    def _merge_rows(self, data, start, size, rows, width):
        ids = np.full((len(rows), width), -1, np.int32)
        inside = np.arange(width) < size[rows][:, None]
        ids[inside] = data[ranges(start[rows], size[rows])]
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            line = np.arange(len(rows))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[line, at] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                full = ids[done] >= 0
                yield rows[done], full.sum(1), ids[done][full]
                rows, ids, rank, at, least = rows[~done], ids[~done], rank[~done], at[~done], least[~done]
                line = line[: len(rows)]
                if not len(rows):
                    return
            ids[line, at] = least
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.ranks(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < rank.shape[1])
            rank[after, at[after]] = self.ranks(ids[after, at[after]], ids[after, at[after] + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges for one very long word, in time n log n."""
        left, right = np.array(ids[:-1]), np.array(ids[1:])
        made = self.ranks(left, right)
        heap = [(int(r), i) for i, r in enumerate(made) if r != NONE]
        heapq.heapify(heap)
        after, before, pair = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), {i: r for r, i in heap}

        def renew(i: int, j: int) -> None:
            pair.pop(i, None)
            if i >= 0 and j < len(ids):
                r = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r != NONE:
                    pair[i] = r
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if pair.get(i) != r:
                continue
            gone = after[i]
            pair.pop(gone, None)
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            renew(i, after[i])
            renew(before[i], i)
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the edges of the texts among the bytes."""
        sums = np.concatenate([[0], np.cumsum(self.size[ids])])
        parts = (ids[k : k + IDS] for k in range(0, max(1, len(ids)), IDS))
        return np.concatenate([self.bytes[ranges(self.start[p], self.size[p])] for p in parts]), sums[edges]


def cut(text: str, size: int) -> list[str]:
    """A long text in parts of about `size` characters. Each cut is before a space that follows no white space: a pre-token starts
    there and none looks ahead past it, so the parts have the same pre-tokens as the text."""
    parts, at = [], 0
    while len(text) - at > size:
        to = text.find(" ", at + size)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        parts.append(text[at:to])
        at = to
    return [*parts, text[at:]]


class Encoder:
    """Texts to ids: pre-tokens by `pattern`, each encoded by itself.

    A text in which no white space stands before a space is cut at its spaces first: there every cut is the start of a
    pre-token, and what follows up to the next space has the same pre-tokens alone as in the text. Other texts are
    matched whole.
    """

    #: white space before a space
    ODD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "

    def __init__(self, merges: Merges, pattern: str):
        import regex

        self.match, self.merges = regex.compile(pattern).findall, merges
        self.pool = Pool(self._encode)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [self.match(u) for u in units]
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for ts in tokens for t in ts))}
        count, ids = self.merges.encode([t.encode() for t in distinct])
        start = np.cumsum(count) - count
        each = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((distinct[t] for ts in tokens for t in ts), np.int64, int(each.sum()))
        sums = np.concatenate([[0], np.cumsum(count[flat])])
        edges = np.concatenate([[0], np.cumsum(each)])
        return np.diff(sums[edges]), ids[ranges(start[flat], count[flat])]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. Nulls are empty."""
        column = column.cast(pa.large_string()).fill_null("")
        if column.nbytes > 2 * BYTES and len(column) == 1:
            found = [self.encoded(pa.array([part], pa.large_string())) for part in cut(column[0].as_py(), BYTES)]
            return np.concatenate([ids for ids, _ in found]), np.sum([count for _, count in found], axis=0)
        return self.encoded(column)

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(column, self.ODD))
        plain = np.flatnonzero(~odd)
        code, distinct, edges = pieces(column.take(pa.array(plain)))
        spaced = np.ones(len(code), np.int64)
        spaced[edges[:-1]] = 0
        code = 2 * code.astype(np.int64) + spaced
        used = np.flatnonzero(np.bincount(code, minlength=1))
        units = [" " + distinct[c >> 1] if c & 1 else distinct[c >> 1] for c in used.tolist()] if len(code) else []
        place = np.zeros(2 * len(distinct) + 1, np.int64)
        if units:
            place[used] = self.pool.look_up(units)
        ids, count = self.pool.gather(place[code], edges)
        if not odd.any():
            return ids, count
        texts = [self.match(t) for t in column.filter(pa.array(odd)).to_pylist()]
        sizes = np.array([len(t) for t in texts])
        more, more_count = self.pool.gather(self.pool.look_up([t for ts in texts for t in ts]), np.concatenate([[0], np.cumsum(sizes)]))
        rows = np.concatenate([plain, np.flatnonzero(odd)])
        counts, both = np.concatenate([count, more_count]), np.concatenate([ids, more])
        order, start = np.argsort(rows), np.cumsum(counts) - counts
        return both[ranges(start[order], counts[order])], counts[order]


def vocabulary(path: str | None = None) -> tuple[list[bytes], str]:
    """Tokens in order of rank and the pattern of pre-tokens; by default from the installed public tokenizers."""
    import public_tokenizers

    return load_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


_made: dict[int, Merges] = {}


def _merges(tokens: list[bytes]) -> Merges:
    """The table, made once a worker."""
    key = hash(tuple(tokens))
    if key not in _made:
        _made[key] = Merges(tokens)
    return _made[key]


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Slices of an array between edges, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


CODED = ["doc_id long", "n_tokens long", "ids binary", "bytes binary"]


def _encoded(encoder: Encoder, batches):
    """Batches of doc_id, n_tokens and ids from those of doc_id and text."""
    for part in chunks(batches, size=BYTES):
        ids, count = encoder(part.column(1))
        edges = np.concatenate([[0], np.cumsum(count)])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), _binary(ids.astype("<u4"), edges * 4)], ["doc_id", "n_tokens", "ids"])


def _decoded(merges: Merges, batches):
    """The same batches with the bytes of their ids."""
    for part in chunks(batches, "ids", size=BYTES):
        data, edges = text_bytes(part.column(2))
        values, at = merges.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), edges // 4)
        yield pa.RecordBatch.from_arrays([*part.columns, _binary(values, at)], ["doc_id", "n_tokens", "ids", "bytes"])


def _over(rows: DataFrame, path: str | None, columns: list[str], scan) -> DataFrame:
    """The rows through `scan`, a function of an encoder and batches. The tokens are of one vocabulary's size."""
    tokens, pattern = vocabulary(path)
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(lambda batches: scan(Encoder(_merges(shared.value), pattern), batches)), ", ".join(columns))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, as bytes) of each row's `text`, in one scan.

    Null and empty texts have no ids. Every row gives one row, repeated ones too; other columns are ignored. A long text
    is encoded in parts, at places where that makes no difference.
    """
    return _over(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, CODED[:3], _encoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `bytes`, what the ids of each row stand for. Null ids stand for no bytes."""
    return _over(encoded.select("doc_id", "n_tokens", "ids"), path, CODED, lambda encoder, batches: _decoded(encoder.merges, batches))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What `decode(encode(docs))` gives, in one pass with one table of merges a task."""
    return _over(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, CODED, lambda encoder, batches: _decoded(encoder.merges, _encoded(encoder, batches)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
