import hashlib
import re

import pytest

from siftwell.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wanted.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(x) for x in wanted}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if got := wanted.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= got
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, D.op2_winnowing(spark, SF).collect()))
    assert got == sorted(brute(docs, items))
    assert any(r[-1] for r in got)


A = " ".join(f"w{i}" for i in range(20))


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_edges(spark, block_bytes):
    docs = [
        (1, None), (2, ""), (3, "..  !"), (4, A), (5, f"x {A.upper()} y"), (6, "a a a a a a a a a a a a a a a"), (7, "short item"),
        (8, "w1 w2 w3"), (9, f"{A} " * 3), (10, " ".join(A.split()[:12])), (11, "é ü " * 9), (12, "pad " * 500 + A), (13, " ".join(A.split()[3:16])),
        (14, "short, ITEM! " * 4), (15, "q " * 20000),
    ]
    items = [(1, A), (2, "Short item"), (3, None), (4, ""), (5, "a " * 14), (6, "é ü é"), (7, A), (10, "w19 w0")]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in D.decontaminate(d, b, block_bytes=block_bytes).collect()]
    assert sorted(got) == sorted(brute(docs, items))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, A)], "doc_id long, text string")
    b = spark.createDataFrame([(1, A)], "item_id long, text string")
    assert D.decontaminate(d, b.limit(0)).collect()[0].n_hit == 0
    assert D.decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_repeated_and_null_ids(spark, block_bytes):
    """Each row gives its own row, in one block or many."""
    items = [(1, A), (2, "Short item"), (3, "w19 w0"), (3, "w19 w0"), (4, "other words")]
    docs = [(1, A), (1, A), (1, f"q {A}"), (1, "short item, other words"), (None, A), (None, A), (None, "short item"), (None, None), (None, None), (2, ""), (2, None), (3, f"{A} {A} short item")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in D.decontaminate(d, b, block_bytes=block_bytes).collect()]
    want = []
    for row in docs:
        doc, n_words, n_hit, _, _, bad = next(brute([row], items))
        listed = sorted(str(i) for i, t in items if next(brute([row], [(i, t)]))[2])
        want.append((doc, n_words, n_hit, len(listed), ",".join(listed), bad))
    by = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=by) == sorted(want, key=by)


def test_repeated_words():
    """Places of equal words count once: a long text of one word against an item of it, and items with one phrase."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siftwell.llm.words import NON_WORD, Words

    items = ["z " * 500, *(f"{A} k{i}" for i in range(300))]
    block = D.Benchmark(list(range(len(items))), pa.array(items))
    assert len(block.set_size) < 330
    words = Words(pa.array(["z " * 100_000, f"a {A} " * 50, "z " * 13 + "y " + "z " * 12]), NON_WORD, lower=True)
    tracemalloc.start()
    flags, (rows, found) = block.hits(words)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert flags[:100_000].all() and np.bincount(rows, minlength=3).tolist() == [1, 300, 1]
    assert flags[words.row == 1].sum() == 50 * 20 and flags[words.row == 2].tolist() == [True] * 13 + [False] * 13


def test_random_texts_of_few_words():
    import random

    import pyarrow as pa

    from siftwell.llm.words import NON_WORD, Words

    rng = random.Random(8)
    for _ in range(40):
        kinds = rng.choice([1, 2, 3, 8])
        text = lambda n: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))  # noqa: B023,E731
        items = [(i, text(rng.randrange(0, 40))) for i in range(12)]
        docs = [(i, f"{text(rng.randrange(60))} {rng.choice(items)[1]} {text(rng.randrange(20))}") for i in range(12)]
        block = D.Benchmark([i for i, _ in items], pa.array([t for _, t in items]))
        got = Words(pa.array([t for _, t in docs]), NON_WORD, lower=True)
        flags, (rows, found) = block.hits(got)
        for d, n_words, n_hit, n_items, _, _ in brute(docs, items):
            own = flags[got.row == d]
            assert (len(own), own.sum(), (rows == d).sum()) == (n_words, n_hit, n_items)
