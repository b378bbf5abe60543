import random
import unicodedata

import pytest

from siftwell.functions.names import name_key
from siftwell.operators import merge_log as M
from siftwell.operators import resolution as R


def key(name):
    """One character at a time from the ends of the folded name."""
    fold = lambda s: unicodedata.normalize("NFKC", s)
    s = " ".join(fold(fold(name).casefold()).split())
    quote = lambda c: c in "\"'`" or unicodedata.category(c) in ("Pi", "Pf")
    while s:
        if s[-1] in ".,;:!? " or quote(s[-1]):
            s = s[:-1]
        elif s[0] == " " or quote(s[0]):
            s = s[1:]
        elif s[0] in "([{" and len(s) > 1 and s[-1] == {"(": ")", "[": "]", "{": "}"}[s[0]]:
            depth = 0
            for i, c in enumerate(s):
                depth += (c == s[0]) - (c == s[-1])
                if depth == 0:
                    break
            if depth or i < len(s) - 1:
                break
            s = s[1:-1]
        else:
            break
    return s


def test_name_keys(spark):
    rng = random.Random(2)
    names = ["".join(rng.choices("()[]{}\"'`«»“”.,;:!? aBßÅ１\t　#+ﬁ", k=rng.randrange(0, 12))) for _ in range(3000)]
    names += ["(Platform Team)", "atlas (beta)", "(a) and (b)", "((x))", "([{«x»}]).", "c++", ".net", "Straße", "\x1cx\x1c\x1cy"]
    found = spark.createDataFrame(list(enumerate(names)), "i long, n string").select("i", name_key("n").alias("k")).collect()
    got = {r.i: r.k for r in found}
    assert [(n, got[i]) for i, n in enumerate(names) if got[i] != key(n)] == []


def sequential(pairs):
    best = {}
    for a, b, s in pairs:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, s), s)
    used, out = set(), []
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], *x[0])):
        if not {a, b} & used:
            used |= {a, b}
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matching(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30), rng.choice([0.9, 0.91, 0.95, 1.0])) for _ in range(rng.choice([0, 10, 120]))]
    pairs += [(100 + i, 101 + i, 0.5 + i / 100) for i in range(12)]  # a chain that goes pair by pair
    found = R.greedy_matching(spark.createDataFrame(pairs, "a long, b long, similarity double"))
    assert sorted(map(tuple, found.collect())) == sequential(pairs)
    assert R.greedy_matching(spark.createDataFrame([], "a long, b long, similarity double")).collect() == []


ENTITIES = [(1, "team", "Atlas", ["The Atlas"]), (2, "team", "atlas.", None), (3, "team", "Bolt", ["the atlas", "B"]), (4, "team", "B", []), (5, "org", "Atlas", None), (6, "team", "Other", ["X"]), (7, "team", "...", None), (8, "team", "!", ["..."])]
SOURCES = [(1, 10, 0.5, "Atlas"), (2, 10, 0.9, "atlas."), (2, 11, None, "ATLAS"), (3, 12, 0.9, "Bolt"), (3, 13, 0.2, "bolt"), (4, 12, 0.9, "B"), (5, 10, 1.0, "Atlas")]


def tables(spark):
    return spark.createDataFrame(ENTITIES, "entity_id long, type string, name string, aliases array<string>"), spark.createDataFrame(SOURCES, "entity_id long, chunk_id long, confidence double, surface_name string")


def test_by_name_is_closed(spark):
    entities, sources = tables(spark)
    log = R.by_name(entities, sources)
    found = {r.merged: (r.survivor, r.method) for r in log.collect()}
    assert found == {1: (2, "exact"), 3: (2, "alias"), 4: (2, "alias")}
    ids = sorted((r.merge_id, r.method) for r in log.collect())
    assert ids[0][1] == "exact" and len({i for i, _ in ids}) == 3
    paths = M.lineage(log)
    aliases = {r.entity_id: r.aliases for r in M.merged_aliases(entities, paths).collect()}
    assert aliases == {2: ["Atlas", "The Atlas", "Bolt", "B"], 5: [], 6: ["X"], 7: [], 8: ["..."]}
    merged = sorted(map(tuple, M.merged_sources(sources, paths).collect()))
    assert merged == [(2, 10, 0.9, "atlas."), (2, 11, None, "ATLAS"), (2, 12, 0.9, "Bolt"), (2, 13, 0.2, "bolt"), (5, 10, 1.0, "Atlas")]


def test_by_similarity(spark):
    _, sources = tables(spark)
    log = R.by_similarity(spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.99), (3, 4, 0.95)], "a long, b long, similarity double"), R.measured(sources), 40)
    assert [(r.survivor, r.merged, r.method, r.merge_id > 40) for r in log.collect()] == [(2, 3, "embedding", True)]


class Graph:
    """The state kept in place: reports by (entity, chunk) and (edge, chunk), as merges and re-extractions patch it."""

    def __init__(self, sources, edges, edge_sources):
        self.sources, self.edges, self.edge_sources = list(sources), dict(edges), list(edge_sources)

    def state(self, roots):
        """Sources and edges with their sources, all by root."""
        up = lambda e: roots.get(e, e)
        sources, edges = {}, {}
        for e, c, _ in self.sources:
            sources.setdefault(up(e), set()).add(c)
        for i, c, _ in self.edge_sources:
            s, d, r = self.edges[i]
            if up(s) != up(d):
                edges.setdefault((up(s), up(d), r), set()).add(c)
        return sources, edges


@pytest.mark.parametrize("seed", range(3))
def test_merge_change_undo_is_a_replay_without_the_merge(spark, seed):
    """Merges are made, chunks get another text whose reports name what is there by then, and then one merge is taken back."""
    rng = random.Random(seed)
    entities = list(range(8))
    chunks = {c: "old" for c in range(10)}
    sources = {(e, c, "old") for e in entities for c in rng.sample(range(10), 3)}
    edges = {i: (*rng.sample(entities, 2), rng.choice(["OWNS", "USES"])) for i in range(14)}
    edge_sources = {(i, c, "old") for i in edges for c in rng.sample(range(10), 2)}
    log = []
    live = entities[:]
    for m in range(1, 5):
        a, b = rng.sample(live, 2)
        log.append((m, a, b))
        live.remove(b)
    undo = rng.choice([m for m, a, b in log if not any(n > m and a in (s, t) for n, s, t in log)])
    new = rng.sample(range(10), 3)
    for c in new:
        chunks[c] = "new"
        sources |= {(e, c, "new") for e in rng.sample(live, 2)}
    d = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
    chunk_table = d(chunks.items(), "chunk_id long, digest string")
    old_chunks = d([(c, "old") for c in chunks], "chunk_id long, digest string")
    log_table = d(log, "merge_id long, survivor long, merged long")
    source_table = d([(e, c, t, 0.5, "x") for e, c, t in sources], "entity_id long, chunk_id long, digest string, confidence double, surface_name string")
    edge_table = d([(i, *x) for i, x in edges.items()], "edge_id long, src long, dst long, relation string")
    edge_source_table = d([(i, c, t, 0.5) for i, c, t in edge_sources], "edge_id long, chunk_id long, digest string, confidence double")
    kept = M.evidence(log_table, M.in_force(source_table, old_chunks), edge_table, M.in_force(edge_source_table, old_chunks), old_chunks)

    def roots(merges):
        out = {}
        for e in entities:
            r = e
            while up := {b: a for _, a, b in merges}.get(r):
                r = up
            while r in {b for _, _, b in merges}:
                r = next(a for _, a, b in merges if b == r)
            if r != e:
                out[e] = r
        return out

    left = [m for m in log if m[0] != undo]
    live_sources = [s for s in sources if chunks[s[1]] == s[2]]
    live_edges = [s for s in edge_sources if chunks[s[1]] == s[2]]
    graph = Graph(live_sources, edges, live_edges)
    want_before, want_after = graph.state(roots(log)), graph.state(roots(left))

    found = {}
    for name, undone in (("before", []), ("after", [undo])):
        paths = M.lineage(M.active(log_table, d([(u,) for u in undone], "merge_id long")))
        now_edges = M.in_force(edge_source_table, chunk_table)
        got_sources = {}
        for r in M.merged_sources(M.in_force(source_table, chunk_table), paths).collect():
            got_sources.setdefault(r.entity_id, set()).add(r.chunk_id)
        ends = M.edge_roots(edge_table, paths)
        of = {r.edge_id: (r.src, r.dst, r.relation) for r in ends.collect() if r.kept == r.edge_id}
        got_edges = {}
        for r in M.merged_edge_sources(now_edges, ends).collect():
            got_edges.setdefault(of[r.edge_id], set()).add(r.chunk_id)
        found[name] = (got_sources, got_edges, paths)
    assert found["before"][:2] == want_before and found["after"][:2] == want_after

    moved = roots([m for m in log if m[0] <= undo])
    survivor, merged = next((a, b) for m, a, b in log if m == undo)
    under = {merged} | {e for e, r in roots([m for m in log if m[0] < undo]).items() if r == merged}
    touched = {c for e, c, _ in sources if e in under and (e, c, "old") in sources} | {c for i, c, _ in edge_sources if {edges[i][0], edges[i][1]} & under}
    assert moved[merged] == survivor
    got = {r.chunk_id for r in M.changed_chunks(kept, d([(undo,)], "merge_id long"), chunk_table).collect()}
    assert got == touched & set(new)

    outcome = {r.edge_id: r.outcome for r in M.undo_outcome(edge_table, M.in_force(edge_source_table, chunk_table), found["before"][2], found["after"][2]).collect()}
    alive = {i for i, _, _ in live_edges}
    for i, kind in outcome.items():
        assert (kind == "unrestored") == (i not in alive)
        assert {edges[i][0], edges[i][1]} & under or kind in ("shared", "restored")  # what it was folded into, or was kept for, is another edge
