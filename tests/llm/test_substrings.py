import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from siftwell.llm import substrings as S
from siftwell.llm.words import SPACE, Words

SF = "/root/testdata/sf0.001"


def brute(docs, size=50):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                least[k] = min(least.get(k, d), d)
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def key(r):
    return (r[0] is not None, *(x if x is not None else 0 for x in r))


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=key)


def all_shared(names):
    return np.ones(len(names), bool)


ROUNDS = [(all_shared, np.zeros(0, np.uint64))] * (S.ROUNDS + 1)


def sample_pair(rng, trial):
    """Two texts that share 50 words, of few different ones, at times with a period or runs at the ends."""
    kind = rng.choice([2, 3, 10, 1000])
    core = [f"w{rng.randrange(kind)}" for _ in range(50)]
    if trial % 4 == 0:
        period = core[: rng.randrange(1, 8)]
        core = (period * 50)[:50]
    if trial % 4 == 1:
        k, m = rng.randrange(1, 50), rng.randrange(1, 50)
        core[:k] = [core[0]] * k
        core[m:] = [core[-1]] * (50 - m)
    around = lambda: [f"w{rng.randrange(kind)}" for _ in range(rng.randrange(60))]
    return [around() + core + around() for _ in range(2)]


def test_shared_windows_share_an_anchor():
    """Whatever stands around a shared window, and however it repeats itself, both have an anchor of one key for it."""
    rng = random.Random(5)
    for trial in range(200):
        words = Words(pa.array([" ".join(t) for t in sample_pair(rng, trial)]), SPACE)
        keys, segments, first, count = S.anchors(words, S.parsed(words, ROUNDS))
        windows, _ = words.windows(50)
        of, told = {}, {}
        for k, seg, f, n in zip(keys.tolist(), segments.tolist(), first.tolist(), count.tolist()):
            own = windows[f : f + n].tolist()
            assert set(told.setdefault((k, seg), own)) == set(own)
            for w in own:
                assert of.setdefault(w, k) == k
        whole = words.row[: len(windows)] == words.row[49 : 49 + len(windows)]
        assert set(windows[whole].tolist()) == set(of)


def test_interior_symbols_are_shared():
    """Symbols that the rounds would call lone, as one text alone has them, never rule out a window that both have."""
    rng = random.Random(6)
    for trial in range(200):
        words = Words(pa.array([" ".join(t) for t in sample_pair(rng, trial)]), SPACE)
        rounds = []
        for _ in range(S.ROUNDS + 1):
            symbols = S.parsed(words, rounds)
            at = symbols.to_name()
            both = np.intersect1d(*(symbols.name[at][symbols.row[at] == r] for r in (0, 1)))
            rounds.append((lambda names, both=both: np.isin(names, both), np.zeros(0, np.uint64)))
        windows, whole = words.windows(50)
        live = S.parsed(words, rounds).windows()
        shared = np.intersect1d(windows[whole & (words.row[: len(windows)] == 0)], windows[whole & (words.row[: len(windows)] == 1)])
        assert len(shared) and live[whole & np.isin(windows, shared)].all()


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, S.op9_recompression(spark, SF).collect()), key=key)
    assert got == sorted(brute(docs), key=key)
    assert any(r[2] for r in got)


def test_edges(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    p, q, r = text(70), text(50), text(49)
    docs = [
        (1, None), (2, ""), (3, " \n "), (4, f"{text(9)} {p}\n{text(30)}"), (5, f"{p} {p}"), (6, p), (6, p), (7, q), (8, q.replace(" ", "\n\t")), (9, f"{r} {text(5)}"), (10, f"{text(3)} {r}"),
        (11, "a " * 300), (12, "a " * 120), (13, "a b " * 80), (14, "b a " * 90), (15, text(20000)), (-1, f"{text(3)} {q} {text(200)}"), (16, "é " * 60), (17, "é " * 49), (None, q), (None, q), (18, "x " + "a " * 49), (6, f"{q} {p}"),
        *((100 + i, f"{text(i % 7)} {p} {text(i % 5)}") for i in range(60)),
    ]
    base = p.split()
    docs += [(200 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(0, 70, 3)]
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, uid int, key string")
    want = sorted(brute(docs), key=key)
    assert result(S.deduplicate(d)) == want
    assert result(S.deduplicate(d, bits=9)) == want  # names clash in every round


def test_rounds(spark):
    """What the rounds settle: shared names, and clashes of names of few bits."""
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(120)]
    docs = [(i, " ".join([f"v{rng.randrange(10**6)}" for _ in range(80)] + shared + ["r"] * 30)) for i in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rounds = S.settled(d)
    assert [len(c) for _, c in rounds] == [0] * len(rounds)
    words = Words(pa.array([docs[0][1]]), SPACE)
    symbols = S.parsed(words, rounds)
    where = symbols.at[symbols.lone]
    assert len(where) and (where < 80).all() and (symbols.size[symbols.at > 90] > 4).any() and 30 in symbols.size.tolist()
    live = symbols.windows()
    assert live[80:].all() and not live[:50].any()
    assert any(len(c) for _, c in S.settled(d, 6))


def test_empty_table(spark):
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_context():
    assert S.context(1) == (2, 2) and S.context(2) == (4, 4) and S.context(3) == (8, 8)
    assert S.ZONE >= S.SYMBOL and S.CONTEXT + S.ZONE - 1 + S.SYMBOL <= S.WINDOW - S.CONTEXT
