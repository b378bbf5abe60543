import random

import pytest

from siftwell.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, min_chars=40, min_docs=5):
    """By plain loops over (doc_id, text); a row is a document, a null doc_id less than all others."""
    number = lambda d: -(1 << 63) if d is None else d
    held = {}
    for d, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(number(d))
    out = []
    for d, text in docs:
        rows = (text or "").split("\n")
        kept = [x for x in rows if len(held.get(key(x), [])) < min_docs or number(d) == max(held[key(x)])]
        out.append((number(d), len(rows), len(rows) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(found):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect())


LONG = "a line that is long enough to be dropped when others hold it"


def edges():
    wide = "é" * 39
    docs = [(None, LONG), (1, None), (2, ""), (3, "\n"), (4, "\n\n" + LONG + "\n"), (5, "  " + LONG.upper() + "\t"), (6, LONG + "\r\nshort\n" + LONG), (7, "x" + LONG), (8, LONG), (8, LONG), (8, LONG + "\nanother text of that id"), (9, f"{LONG} ")]
    docs += [(10 + i, wide + ("e" if i % 2 else "E") + "\nshort line") for i in range(5)]  # exactly 40 code points, 79 bytes
    docs += [(20 + i, "é" * 39 + "\nÉ" + "z" * 40) for i in range(6)] + [(30 + i, "é" + "z" * 40) for i in range(4)]  # 39; É isn't é
    docs += [(40 + i, "four rows only hold this line, so that it stays where it is") for i in range(4)]
    docs += [(50, "\n".join([LONG, "own line of this very long text"] * 20_000))]
    return docs


@pytest.mark.parametrize("batches, fanout", [(1, 4), (4, 2), (7, 3)])
def test_edges(spark, batches, fanout):
    docs = edges()
    rows = spark.createDataFrame([(d, t, i, "x", "y") for i, (d, t) in enumerate(docs)], "doc_id long, text string, doc long, cut string, lines string").repartition(3)
    assert got(L.dedup_lines(rows, batches=batches, fanout=fanout)) == brute(docs)


def test_random(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["alpha", "beta", "Gamma", "delta", "ñandú"], k=rng.randrange(5, 11))) for _ in range(40)]
    docs = [(rng.randrange(400) - 20, "\n".join(rng.choice([p, p.upper(), f" {p} "]) for p in rng.choices(pool, k=rng.randrange(0, 6)))) for _ in range(500)]
    assert got(L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=5, fanout=2)) == brute(docs)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rare_lines_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 3)
    docs = [(i, "\n".join(f"line number {j} is held by some of the documents of this test" for j in range(12) if i % (j + 1) == 0)) for i in range(60)]
    assert got(L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_runs_are_levelled_and_replays_change_nothing(spark):
    runs = L.LineRuns(spark, fanout=3, buckets=4)
    batches = [spark.createDataFrame([(i, f"{LONG} number {i % 4} of batch {b // 5}") for i in range(6)], "doc_id long, text string") for b in range(10)]
    for b, docs in enumerate(batches):
        runs.add(b, L.batch_lines(docs))
    assert runs.runs("seen") == runs.runs("counts") == [(0, 8), (9, 9)]
    before = sorted(map(tuple, runs.frequent(1).collect()))
    assert len(before) == 8 and {r[2] for r in before} == {5, 10}
    runs.add(7, L.batch_lines(batches[0]))
    again = L.LineRuns(spark, runs.path, fanout=3, buckets=4)  # another session's view of the same folder
    again.add(9, L.batch_lines(batches[9]))
    assert sorted(map(tuple, again.frequent(1).collect())) == before
    assert again.unseen(L.batch_lines(batches[3])).count() == 0
    assert again.unseen(L.batch_lines(spark.createDataFrame([(1, LONG)], "doc_id long, text string"))).count() == 1


def test_a_broken_merge_is_not_in_force(spark):
    runs = L.LineRuns(spark, fanout=2, buckets=2)
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    runs.add(0, L.batch_lines(docs))
    runs._write("seen", (0, 1), L.batch_lines(docs))
    L.delete(spark, f"{runs.path}/seen/{0:09d}-{1:09d}/_SUCCESS")
    assert runs.runs("seen") == [(0, 0)]


def test_runs_are_merged_without_an_exchange(spark):
    runs = L.LineRuns(spark, fanout=9, buckets=4)
    docs = spark.createDataFrame([(i, f"{LONG} {i}") for i in range(50)], "doc_id long, text string")
    for b in range(3):
        runs.add(b, L.batch_lines(docs.where(f"doc_id % 3 = {b}")))
    plan = runs.unseen(runs.read("counts", (2, 2)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


def test_native(spark):
    plan = L.dedup_lines(spark.createDataFrame(edges()[:8], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
