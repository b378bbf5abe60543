import random

import pytest

from siftwell.operators import merge_log as M

LOG = [(1, 10, 11), (2, 20, 21), (3, 10, 20)]


def tables(spark):
    log = spark.createDataFrame(LOG, "merge_id long, survivor long, merged long")
    sources = spark.createDataFrame([(10, 1, 0.4), (11, 1, 0.9), (21, 2, None), (30, 2, 0.1)], "entity_id long, chunk_id long, confidence double")
    edges = spark.createDataFrame([(10, 11, "OWNS", 1, 0.5), (21, 30, "OWNS", 2, 0.2), (11, 30, "OWNS", 3, 0.7)], "src long, dst long, relation string, edge_id long, confidence double")
    return log, sources, edges


def undone(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "merge_id long")


def test_replay_and_undo(spark):
    log, sources, edges = tables(spark)
    found = M.roots(M.active(log, undone(spark)))
    assert {r.entity_id: r.root for r in found.collect()} == {11: 10, 20: 10, 21: 10}
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(M.merged_sources(sources, found)) == [(10, 1, 0.9), (10, 2, None), (30, 2, 0.1)]
    assert key(M.merged_edges(edges, found)) == [(10, 30, "OWNS", 2, 0.7)]
    none = M.roots(M.active(log, undone(spark, 1, 2, 3)))
    assert key(M.merged_sources(sources, none)) == key(sources)
    assert key(M.merged_edges(edges, none).select("src", "dst", "relation", "edge_id", "confidence")) == key(edges)
    part = M.roots(M.active(log, undone(spark, 3)))
    assert {r.entity_id: r.root for r in part.collect()} == {11: 10, 21: 20}


def test_later_merges_block(spark):
    log, *_ = tables(spark)
    assert {r.merge_id for r in M.blocking(log, undone(spark), 1).collect()} == {3}
    assert {r.merge_id for r in M.blocking(log, undone(spark), 2).collect()} == {3}
    assert M.blocking(log, undone(spark, 3), 2).isEmpty() and M.blocking(log, undone(spark), 3).isEmpty()


def test_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        M.roots(spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "merge_id long, survivor long, merged long"))


def test_many_merges_in_a_row(spark):
    log = spark.createDataFrame([(i, i + 1, i) for i in range(1, 41)], "merge_id long, survivor long, merged long")
    assert {r.entity_id: r.root for r in M.roots(log).collect()} == {i: 41 for i in range(1, 41)}
    assert M.roots(log.limit(0)).count() == 0


def test_an_undo_asks_for_the_sources_of_what_it_touches(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i, 1000, "OWNS") for i in range(1, 101)], "edge_id long, src long, dst long, relation string")
    sources = spark.createDataFrame([(i, c, 0.5) for i in range(1, 101) for c in (i, i + 1)], "edge_id long, chunk_id long, confidence double")
    before = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "entity_id long, root long")
    asked, merged = [], M.merged_edge_sources
    monkeypatch.setattr(M, "merged_edge_sources", lambda s, kept: asked.append(kept.count()) or merged(s, kept))
    outcome = {r.edge_id: r.outcome for r in M.undo_outcome(edges, sources, before, before.where("entity_id <> 3")).collect()}
    assert outcome == {1: "shared", 3: "restored"}
    assert max(asked) == 3  # of 100 edges


def test_outcomes_are_those_of_both_sides_found_apart(spark, monkeypatch):
    rng = random.Random(5)
    edges, sources = [], []
    for e in range(1, 121):
        edges.append((e, rng.randrange(12), rng.randrange(12), rng.choice(["OWNS", "OWNS", "MADE", None])))
        sources += [(e, c, rng.choice([None, 0.25, 0.5])) for c in rng.sample(range(6), rng.randrange(3))]
    log = [(i + 1, s, m) for i, (s, m) in enumerate([(0, 1), (2, 3), (0, 2), (4, 5), (6, 7), (4, 6), (8, 5)])]  # 5 is merged twice: the latest counts
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    log_, edges_, sources_ = frame(log, "merge_id long, survivor long, merged long"), frame(edges, "edge_id long, src long, dst long, relation string"), frame(sources, "edge_id long, chunk_id long, confidence double")
    asked, merged = [], M.merged_edge_sources
    monkeypatch.setattr(M, "merged_edge_sources", lambda s, kept: asked.append(1) or merged(s, kept))
    alive, seen = {e for e, *_ in sources}, set()
    for taken_back in ([3], [7], [1, 4], [2, 3, 6], []):
        found = [M.roots(M.active(log_, undone(spark, *ids))) for ids in ((), taken_back)]
        sides = [{r.edge_id: r for r in M.edge_roots(edges_, f).collect()} for f in found]

        def held(side):
            out = {}
            for e, c, x in sources:
                if e in side:
                    out.setdefault(side[e].kept, {}).setdefault(c, []).append(x)
            return {k: {c: max((x for x in xs if x is not None), default=None) for c, xs in own.items()} for k, own in out.items()}

        old, new = map(held, sides)
        want = {}
        for e, *_ in edges:
            a, b = (s.get(e) for s in sides)
            ends, was, now = (a and (a.src, a.dst)) != (b and (b.src, b.dst)), bool(a and a.kept == e), bool(b and b.kept == e)
            changed = ends or was != now
            if e not in alive:
                outcome = "unrestored" if changed else None
            else:
                outcome = "restored" if now and not was else "moved" if now and changed else "shared" if now and old[e] != new[e] else None
            if outcome:
                want[e] = outcome
        asked.clear()
        assert {r.edge_id: r.outcome for r in M.undo_outcome(edges_, sources_, *found).collect()} == want
        assert len(asked) == 1  # sources are met once for both sides
        seen |= set(want.values())
    assert seen == {"unrestored", "restored", "moved", "shared"}
