import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from siftwell.llm import align as L

A = Tokenizer.from_file(public_tokenizers.path(L.A))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path(L.B))
LETTERS = L.byte_letters()


def tokens(text):
    """(id, bytes) of each token by both libraries, whole text by whole text; none if bytes differ."""
    own = (" " + text).encode() if text else b""
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids] if text else []
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))] if text else []
    return (a, b) if b"".join(t for _, t in a) == own == b"".join(t for _, t in b) else ([], [])


def groups(a, b):
    out, own, ends = [], ([], []), [0, 0]
    sides = [iter(a), iter(b)]
    while True:
        side = 0 if ends[0] <= ends[1] else 1
        got = next(sides[side], None)
        if got is None:
            return out
        own[side].append(got[0])
        ends[side] += len(got[1])
        if ends[0] == ends[1]:
            out.append(own)
            own = ([], [])


def brute(docs):
    each = [(d, groups(*tokens(t or ""))) for d, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in each]
    n = Counter(p for c in links for p in c)
    top = Counter()
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    out = []
    for (d, g), c in zip(each, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(k for p, k in c.items() if n[p] == top[p[0]]), sum(k * n[p] for p, k in c.items()), text))
    return sorted(out, key=str)


def got(found):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect()), key=str)


ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "\n", "a\nb", "a \n b", " \n", "x▁y", "▁", "<|endoftext|>", "a <s> </s> <unk> <0x41>", "\x00", "naïve café", "漢字かな交じり文", "😀😀 👩‍👩‍👧", "don't we'll I'd", "1234567 89",
    "a b   c", "tab\t\ttab", "a" * 500, "́é", "ÅÄÖ" * 40, "\r\n \r\n", "word, word. word! (word)", "end　 next", "\x1c x", "\x85 x", "﻿bom", "a" + " " * 40 + "b", "\U0001f468" * 30,
]


def corpus(n, seed):
    rng = random.Random(seed)
    some = ["the", "therefore", "ciónñgaco", "Ñez", "rosó,", "x.", "  ", "\n", "\n\n", "日本語", "é", "emb▁ed", "3,14", "😀", "HTTPServer", "foo_bar"]
    return [" ".join(rng.choices(some[:-5] if rng.random() < 0.7 else some, k=rng.randrange(1, 60))) for _ in range(n)]


def rows(spark, docs):
    return spark.createDataFrame([(d, t, "x", i, "y") for i, (d, t) in enumerate(docs)], "doc_id long, text string, groups string, at int, pair string").repartition(3)


@pytest.mark.parametrize("most", [L.MOST, 40, 0])
def test_like_both_libraries(spark, monkeypatch, most):
    monkeypatch.setattr(L, "BYTES", 3000)
    texts = [*ODD, *corpus(120, 1), *corpus(5, 2) * 3]
    docs = [*enumerate(texts), (None, "repeated row"), (None, "repeated row"), (7, "of an id that is there")]
    assert got(L.align(rows(spark, docs), most=most)) == brute(docs)


def test_digest(spark):
    docs = list(enumerate([*ODD[:12], "plain words here"]))
    text = {r.doc_id: r.groups for r in L.align(rows(spark, docs)).collect()}
    assert {r.doc_id: r.groups for r in L.align(rows(spark, docs), digest=True).collect()} == {d: hashlib.sha256(t.encode()).hexdigest() if t else "" for d, t in text.items()}


def test_empty(spark):
    assert L.align(rows(spark, [(1, "a")]).limit(0)).collect() == []
    assert got(L.align(rows(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("digest", [True, False])
def test_long_texts_in_parts(spark, monkeypatch, digest):
    monkeypatch.setattr(L, "BYTES", 100)
    texts = [" ".join(corpus(20, 3)).replace("▁", ""), " ".join(corpus(20, 3)).replace("▁", "") + " ▁", "a " * 900, "a " * 400 + " ", " " + "b " * 500, "漢" * 3000]
    docs = list(enumerate(texts))
    want = brute(docs)
    found = got(L.align(rows(spark, docs), digest=digest))
    assert [r[:7] for r in found] == [r[:7] for r in want]
    assert [r[7] for r in found] == [hashlib.sha256(r[7].encode()).hexdigest() if digest and r[7] else r[7] for r in want]


def test_large_groups(monkeypatch):
    """Groups counted by distinct ids, and links written out in slices, give the same pairs."""
    import public_tokenizers as P

    pair = L.Pair(open(P.path(L.A)).read(), open(P.path(L.B), "rb").read())
    column = pa.array([t for t in [*ODD, *corpus(30, 5)] if t], pa.large_string())
    whole = L.Aligned(pair, column)
    monkeypatch.setattr(L, "LARGE", 3)
    monkeypatch.setattr(L, "LINKS", 5)
    other = L.Aligned(pair, column)
    assert whole.keys.tolist() == other.keys.tolist() and whole.times.tolist() == other.times.tolist()
