import hashlib
import random

import numpy as np
import pyarrow as pa
import tiktoken

from siftwell.llm import bpe as B

SF = "/root/testdata/sf0.001"
TOKENS, PATTERN = B.vocabulary()
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def encoded(texts):
    ids, count = B.Encoder(B.Merges(TOKENS), PATTERN)(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if texts else []


def test_like_tiktoken_on_odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", "'T", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "漢字", "😀", " ", " ", "\u0085", "\x1c", "\x0b", "1", "23", "...", "#", "the", " and", "́", "ﬁ", "<|endoftext|>", "\x00", "İ"]
    texts = ["", None, " ", "  ", "a ", " a", "a  b", "a \n b", "\n \n", "the  ", "x  y", "x  y"] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(3000)]
    assert encoded(texts) == [TRUTH.encode_ordinary(t or "") for t in texts]


def test_long_words():
    rng = random.Random(4)
    texts = ["a" * 5000, "ab" * 3000, " " * 4000, "".join(rng.choices("abcdefgh", k=6000)), "é" * 3000, "=" * 2049, "x" * 2048, "the " * 40000]
    assert encoded(texts) == [TRUTH.encode_ordinary(t) for t in texts]


def test_texts_longer_than_a_part(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(B, "BYTES", 50)
    monkeypatch.setattr(B, "IDS", 7)
    alphabet = ["a", "the", " ", " ", "  ", "\n ", "\u3000 ", "é", "漢字", "'s", "12", "x" * 60, "\x1c ", "\xa0"]
    merges = B.Merges(TOKENS)
    encoder = B.Encoder(merges, PATTERN)
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60, 200)))
        ids, count = encoder(pa.array([text]))
        assert ids.tolist() == TRUTH.encode_ordinary(text) and count.tolist() == [len(ids)]
        values, edges = merges.decode(ids.astype(np.int64), np.array([0, len(ids)]))
        assert values.tobytes().decode() == text and edges.tolist() == [0, len(values)]


def test_the_pool_starts_anew():
    encoder = B.Encoder(B.Merges(TOKENS), PATTERN)
    encoder.pool.most = 10
    for k in range(3):
        assert encoder(pa.array([f"some words {k}"]))[0].tolist() == TRUTH.encode_ordinary(f"some words {k}")
    assert encoder.pool.size < 100


def brute(rows):
    for doc, text in rows:
        ids = TRUTH.encode_ordinary(text or "")
        yield doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, B.op8_byte_bpe(spark, SF).collect())) == sorted(brute(docs))


def test_edges(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, " "), (3, " "), (4, "é" * 70000), (5, "a  b"), (6, "z " * 90000), (-1, "neg")]
    spark.createDataFrame([(*r, b"x", 3) for r in docs], "doc_id long, text string, ids binary, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, B.op8_byte_bpe(spark, str(tmp_path)).collect())) == sorted(brute(docs))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(B.decode(B.encode(table)).collect()) == sorted(B.round_trip(table).collect())


def test_empty_table(spark):
    assert B.decode(B.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
