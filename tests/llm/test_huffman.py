import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm import huffman as H

SF = "/root/testdata/sf0.001"
TRUTH = Tokenizer.from_file(public_tokenizers.path(H.VOCABULARY))


def brute(rows):
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*TRUTH.encode(text or "", add_special_tokens=False).ids, 1]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def key(r):
    return r[1]


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, H.op5_huffman_ids(spark, SF).collect()), key=key) == list(brute(docs))


def test_edges(spark, tmp_path):
    docs = [(5, None), (2, ""), (3, " \n\t\r\n "), (9, "The  END.\tof é́ É 漢字　x\x1cy\x0bz\x85w"), (4, "word " * 70000), (7, "x" * 30000), (-3, "a b İ ΑΣ ΑΣ."), (8, "it's <|endoftext|>don't"), (8, "it's <|endoftext|>don't"), (None, "lost")]
    spark.createDataFrame([(*r, 1, b"") for r in docs], "doc_id long, text string, n long, packed binary").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, H.op5_huffman_ids(spark, str(tmp_path)).collect()), key=key) == list(brute(docs))
    H.write_ids(spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/ids")
    back = {r.doc_id: np.frombuffer(r["ids"], "<u4").tolist() for r in H.read_ids(spark, f"{tmp_path}/ids").collect()}
    assert back[4] == [*TRUTH.encode(docs[4][1], add_special_tokens=False).ids, 1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert H.op5_huffman_ids(spark, str(tmp_path)).count() == 0


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_code_is_optimal_and_limited(n):
    counts = np.random.default_rng(n).zipf(1.5, n).clip(0, 10**9)
    free = H.code_lengths(counts, 60 if n < 1000 else 40)
    if n > 1:
        assert (free * counts).sum() == huffman_cost(counts.tolist())
    for limit in (12, 16):
        bits = H.code_lengths(counts, limit)
        assert bits.max() <= limit and (0.5 ** bits[bits > 0]).sum() <= 1


def test_round_trip_in_blocks():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.2, 200000) % 40000).astype(np.int64)
    code = H.Code(H.code_lengths(np.bincount(ids), 16))
    cuts = [0, 1, 1, 513, 70000, 200000]
    blocks = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    back = code.unpack([(*code.pack(b), len(b)) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))


def test_marks_and_letters_in_any_mixture():
    rng, signs = np.random.default_rng(5), [*"aZ.,!$'\"<|>[]`9 \n", " ", "'s", "don't", "é", "é", "İ", "ŉ", "ǅ", "Ɀ", "×", "क़", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "̸", "̇", "word"]
    texts = ["".join(rng.choice(signs, n)) + " " for n in rng.integers(1, 30, 4000)]
    ids, count = H.encoder(open(public_tokenizers.path(H.VOCABULARY)).read())(pa.array(texts))
    ends = np.cumsum(count)
    for text, own in zip(texts, np.split(ids, ends[:-1])):
        assert own.tolist() == [*TRUTH.encode(text, add_special_tokens=False).ids, 1], text
