import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import lexical as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """item_id, rank, doc_id and score by plain loops, sorted; a null doc_id comes last in a tie."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(c for *_, c in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for i, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, b, c in bags:
            m = 100 - 25 + 25 * c * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, q in asked.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


def corpus(n, seed, copies=0.2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ñandú", "ÑANDÚ", "x_y", "a-b", "漢字", "3d"]
    docs = []
    for i in range(n):
        text = docs[rng.randrange(i)][1] if i and rng.random() < copies else " ".join(vocabulary[min(int(rng.paretovariate(0.6)), len(vocabulary)) - 1] for _ in range(rng.randrange(0, 60)))
        docs.append((i * 3 % 1009, text))
    return docs


EDGE = [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, None), (6, ""), (7, " -- "), (8, "w1 w2 w3"), (8, "w1 w2 w3"), (8, "w9 w1"), (9, "é É e E"), (2000, "w1 w7 " * 20_000), (-4, "w1 w2 w3")]
ITEMS = [(1, "w1 W2 w3 w3, w250"), (2, None), (3, ""), (4, "nothing of this"), (5, "É ñandú a b"), (6, " ".join(f"w{i}" for i in range(300))), (None, "w7 w7 w9"), (1, "w11"), (1, "w11")]


@pytest.mark.parametrize("shard, opened", [(1 << 12, 32), (37, 4), (3, 1)])
def test_like_plain_loops(spark, monkeypatch, shard, opened):
    monkeypatch.setattr(X, "SHARD_DOCS", shard)
    monkeypatch.setattr(X, "OPEN", opened)
    docs = corpus(400, shard) + EDGE
    rows = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, term string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, rank int, item string")
    assert got(X.search(rows, items)) == brute(docs, ITEMS)


def test_blocks_of_queries_and_an_index_of_all_terms(spark, monkeypatch):
    docs = corpus(150, 3)
    rows, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(X.search(rows, items, k=3, block_bytes=40)) == brute(docs, ITEMS, 3)
    whole = X.build(rows)
    assert got(X.search(rows, items, k=1000, index=whole)) == brute(docs, ITEMS, 1000)
    monkeypatch.setattr(X, "ASKED", 10)
    assert X.asked_terms(items.na.fill(""), 10) is None


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert X.search(docs, one).collect() == [] and X.search(one.withColumnRenamed("item_id", "doc_id"), items).collect() == []


def test_tree_keeps_both_orders():
    """At each level a term's range holds the documents of a node in order of impact; bounds hold and leaves are exact."""
    rng = np.random.default_rng(1)
    docs = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in (40, 7, 1)])
    impacts = rng.integers(1, 900_000, len(docs))
    tree = X.Tree.read(dict(zip(X._names(X.TREES), [p.tobytes() for p in X.Tree.build(np.arange(50), np.array([3, 5, 9], np.uint64), np.array([40, 7, 1]), docs, impacts).parts()])))
    s, e = (x[None] for x in tree.ranges(np.array([3, 5, 9, 10], np.uint64)))
    nodes = [(0, s, e)]
    weights = np.array([2, 3, 5, 7])
    exact = {d: sum(int(w) * int(i) for w, term in zip(weights, np.split(np.arange(48), [40, 47])) for i in impacts[term][docs[term] == d]) for d in range(50)}
    for level in range(1, tree.bits + 1):
        nodes = [(2 * p + side, *(x[side : side + 1] for x in tree.opened(np.array([level - 1]), a, b))) for p, a, b in nodes for side in (0, 1)]
        for p, a, b in nodes:
            under = [d for d in range(50) if d >> (tree.bits - level) == p]
            assert (b - a)[0].tolist() == [*(int(np.isin(docs[term], under).sum()) for term in np.split(np.arange(48), [40, 47])), 0]
            bound = tree.bounds(np.array([level]), a, b, weights)[0]
            assert bound >= max([exact[d] for d in under], default=0)
            assert level < tree.bits or bound == (exact[p] if under else 0)


def test_few_nodes_are_opened(monkeypatch):
    """A rare term's documents are found without opening all nodes."""
    ids, common = np.arange(4096), np.full(4096, 10)
    docs, impacts = np.concatenate([ids, [77]]), np.concatenate([common, [500]])
    tree = X.Tree.build(ids, np.array([1, 2], np.uint64), np.array([4096, 1]), docs, impacts)
    opened = []
    whole = X.Tree.opened
    monkeypatch.setattr(X.Tree, "opened", lambda self, level, a, b: opened.append(len(level)) or whole(self, level, a, b))
    monkeypatch.setattr(X, "OPEN", 1)
    best = X.Best(3)
    tree.search(np.array([1, 2], np.uint64), np.array([1, 9]), best)
    assert best.ids.tolist() == [77, 0, 1] and sum(opened) < 60
