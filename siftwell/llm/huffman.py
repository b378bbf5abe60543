"""Token ids in files of canonical, length-limited Huffman codes.

One code is made from the counts of all ids. Ids are packed in independent blocks; each has the bit offset of every
`STRIDE`-th id, so that decoding starts at all of these places at once and takes one table look-up an id.

A file set is a folder with two Parquet tables: `code` (id, bits) holds code lengths, from which the canonical code
follows; `blocks` holds the packed blocks with their documents, in ascending order of doc_id over (part, first).
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.shared import shared_dir, stored
from siftwell.llm.units import Pool, pieces
from siftwell.llm.words import chunks, ranges

VOCABULARY, END = "word_bpe_49k.json", 1
#: Ids from one bit-offset checkpoint to the next; ids after which a block is closed; bytes of text encoded at once.
STRIDE, BLOCK, BYTES = 512, 1 << 16, 4 << 20
#: Words that a worker remembers.
WORDS = 300_000
#: Letters that stay letters, one for one, when normalised; marks that no special token holds.
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]", "[!-/:;=?@\\[-`{}~]"
BLOCKS = "part int, first long, doc_ids array<long>, sizes array<long>, n long, offsets array<long>, packed binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits by package-merge; 0 for symbols that don't occur."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) <= 1:
        out[symbols] = 1
        return out
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols need more than {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    out[symbols] = depth
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, equal ones in order of id."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.uint64)
        self.limit = max(1, int(bits.max(initial=1)))
        used = np.flatnonzero(bits)
        order = used[np.lexsort((used, bits[used]))]
        step = np.uint64(1) << (np.uint64(self.limit) - self.bits[order])
        ends = np.cumsum(step)
        self.code = np.zeros(len(bits), np.uint64)
        self.code[order] = (ends - step) >> (np.uint64(self.limit) - self.bits[order])
        # the next `limit` bits of a stream tell the id and the length of its code
        self.symbol, self.length = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        self.symbol[:total] = np.repeat(order, step.astype(np.int64))
        self.length[:total] = np.repeat(bits[order], step.astype(np.int64))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits, most significant first, and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.bits[ids]
        if not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        at = ends - bits
        word, shift = (at >> np.uint64(5)).astype(np.int64), np.uint64(64) - bits - (at & np.uint64(31))
        value = self.code[ids] << shift
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] >> np.uint64(5)) + 2, np.uint32)
        out[word[new]] = np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), new)
        out[word[new] + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), new)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::STRIDE].astype(np.int64)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks given as (packed, offsets, number of ids); all their checkpoints are followed together."""
        data = np.frombuffer(b"".join(b + b"\0\0\0\0" for b, _, _ in blocks), np.uint8).astype(np.uint32)
        four = np.zeros(len(data) + 8, np.uint32)
        for k in range(4):
            four[: len(data) - k] |= data[k:] << np.uint32(24 - 8 * k)
        base = np.cumsum([0, *(len(b) + 4 for b, _, _ in blocks)])[:-1]
        at = np.concatenate([o + 8 * s for (_, o, _), s in zip(blocks, base)])
        out = np.zeros((STRIDE, len(at)), np.uint32)
        low, free = (1 << self.limit) - 1, 32 - self.limit
        for k in range(STRIDE):
            byte = np.minimum(at >> 3, len(four) - 1)
            peek = (four[byte] >> (free - (at & 7)).astype(np.uint32)) & np.uint32(low)
            out[k] = self.symbol[peek]
            at = at + self.length[peek]
        lanes = np.cumsum([0, *(len(o) for _, o, _ in blocks)])
        return [out[:, lanes[i] : lanes[i + 1]].T.ravel()[:n] for i, (_, _, n) in enumerate(blocks)]


def encoder(definition: str):
    """Texts to ids, with the end id after each, by the tokenizers library; each distinct word is encoded once a task.

    The tokenizer has to treat white space as the end of a token and drop it, as VOCABULARY does.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_str(definition)
    # for plain lower-case words neither the normaliser nor the pattern has anything to do
    simple = Tokenizer(tokenizer.model)
    simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    one_word = re.compile(f"{LETTER}+").fullmatch  # one word to the tokenizer
    last = np.zeros(tokenizer.get_vocab_size(), bool)  # tokens that end a word
    last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def words(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((x is not None for x in map(one_word, units)), bool, len(units))
        at = np.flatnonzero(plain)
        texts = [" ".join([units[i] for i in at[k : k + 1000].tolist()]).lower() for k in range(0, len(at), 1000)]
        ids = [np.array(e.ids, np.uint32) for e in simple.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        count = np.zeros(len(units), np.int64)
        count[at] = np.diff(np.flatnonzero(last[ids]), prepend=-1)
        rest = np.flatnonzero(~plain)
        more = [e.ids for e in tokenizer.encode_batch_fast([units[i] for i in rest.tolist()], add_special_tokens=False)]
        count[rest] = [len(x) for x in more]
        out = np.empty(int(count.sum()), np.uint32)
        start = np.cumsum(count) - count
        out[ranges(start[at], count[at])] = ids
        out[ranges(start[rest], count[rest])] = np.fromiter((x for i in more for x in i), np.uint32, int(count[rest].sum()))
        return count, out

    pool = Pool(words, WORDS)

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = column.cast(pa.large_string()).fill_null("")
        for c in "\n\t\r":
            plain = pc.replace_substring(plain, c, " ")
        # marks between a letter and white space are a word to the tokenizer, with or without white space before them
        plain = pc.replace_substring_regex(plain, f"({LETTER})({MARK}+) ", "\\1 \\2 ")
        if not pc.any(pc.match_substring(plain, "<|")).as_py():  # else capitals tell text from special tokens
            plain = pc.ascii_lower(plain)
        code, distinct, edges = pieces(plain)
        place = pool.look_up(distinct)
        ids, count = pool.gather(place[code], edges)
        ends = np.cumsum(count)
        return np.insert(ids, ends, np.uint32(END)), count + 1

    return encode


IDS = "part int, doc_id long, within long, ids binary"


def encoded(docs: DataFrame, definition: str) -> DataFrame:
    """IDS of each document in ascending order of doc_id: the range it falls in, ids before it there, its own ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def scan(batches):
        encode, before, part_id = None, 0, TaskContext.get().partitionId()
        for part in chunks(batches, size=BYTES):
            encode = encode or encoder(shared.value)
            ids, count = encode(part.column(1))
            within = before + np.cumsum(count) - count
            before += len(ids)
            edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * 4
            own = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), part_id), pa.int32()), part.column(0), pa.array(within, pa.int64()), own], [c.split()[0] for c in IDS.split(", ")])

    return docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text").mapInArrow(scan, IDS)


def count_ids(ids: DataFrame) -> DataFrame:
    """id, n over all documents."""

    def scan(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for own in batch.column(0):
                n = np.bincount(np.frombuffer(own.as_buffer(), "<u4"))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return ids.select("ids").mapInArrow(scan, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def packed(ids: DataFrame, bits: np.ndarray) -> DataFrame:
    """BLOCKS of consecutive documents, each closed after BLOCK ids or where the next document isn't at hand."""
    shared = ids.sparkSession.sparkContext.broadcast(bits)
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def scan(batches):
        code, held, size = Code(shared.value), [], 0

        def block():
            values = np.concatenate([x for *_, x in held])
            data, offsets = code.pack(values)
            row = [held[0][0], held[0][2], [h[1] for h in held], [len(h[3]) for h in held], len(values), offsets, data]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for part, doc, within, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if held and (size >= BLOCK or (part, within) != (held[0][0], held[0][2] + size)):
                    yield block()
                    held, size = [], 0
                held.append((part, doc, within, np.frombuffer(own.as_buffer(), "<u4").astype(np.int64)))
                size += len(held[-1][3])
        if held:
            yield block()

    return ids.mapInArrow(scan, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes all texts and writes the file set in ascending order of doc_id (nulls first; equal ones by text).

    Texts are encoded once, into a table in the shared folder from which counts and blocks are made. Null and empty texts
    are the end id alone. Repeated rows are each written; other columns are ignored.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path(VOCABULARY)) as file:
        definition = file.read()
    ids = stored(encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), definition))
    counts = {r.id: r.n for r in count_ids(ids).collect()}  # one entry an id of the vocabulary at most
    table = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, n in counts.items():
        table[i] = n
    bits = code_lengths(table, max(16, int(max(1, len(counts)) - 1).bit_length()))
    used = np.flatnonzero(bits)
    spark.createDataFrame(list(zip(used.tolist(), bits[used].tolist())), "id long, bits int").write.mode("overwrite").parquet(f"{path}/code")
    packed(ids, bits).write.mode("overwrite").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (little-endian unsigned 32-bit integers, as
    bytes) or, with `digest`, their unsigned crc32, from a file set."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{path}/code").collect()}
    bits = np.zeros(max(lengths, default=0) + 1, np.int64)
    for i, n in lengths.items():
        bits[i] = n
    shared = spark.sparkContext.broadcast(bits)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    kind = "ids_crc32 long" if digest else "ids binary"

    def scan(batches):
        code = Code(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                rows = batch.slice(k, 16).to_pylist()
                docs, parts, starts, sizes, values = [], [], [], [], []
                for r, ids in zip(rows, code.unpack([(r["packed"], np.array(r["offsets"], np.int64), r["n"]) for r in rows])):
                    ends = np.cumsum(r["sizes"])
                    own = ids.astype("<u4").tobytes()
                    docs += r["doc_ids"]
                    parts += [r["part"]] * len(ends)
                    starts.append(r["first"] + ends - r["sizes"])
                    sizes.append(r["sizes"])
                    each = (own[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), r["sizes"]))
                    values += [zlib.crc32(x) for x in each] if digest else list(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(values, pa.int64() if digest else pa.binary())],
                    ["doc_id", "part", "within", "n_tokens", kind.split()[0]],
                )

    found = blocks.select("part", "first", "doc_ids", "sizes", "n", "offsets", "packed").mapInArrow(scan, f"doc_id long, part int, within long, n_tokens long, {kind}")
    total, bases = 0, []
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition of the writer
        bases.append((r.part, total))
        total += r.n
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return found.join(base, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", kind.split()[0])


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, digest=True)
