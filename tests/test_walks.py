import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators import graph_claims as C
from siftwell.operators import walks as W
from tests.test_resolution import key

CHUNKS = [(1, 1, 1), (2, 2, 2), (3, 3, 1)]  # chunk, document, collection: open, secret, open
OPEN, SECRET, OPEN2 = 1, 2, 3
ALL, RESTRICTED = (True, None, None, None), (True, None, None, [2])


class Graph:
    def __init__(self):
        self.ids, self.node_sources, self.edges, self.edge_sources = {}, [], [], []

    def entity(self, *names, chunks=(OPEN,)):
        for name in names:
            self.ids[name] = len(self.ids) + 1
            self.node_sources += [(self.ids[name], c, None, name) for c in chunks]

    def edge(self, src, relation, dst, chunks=(OPEN,), confidence=None):
        self.edges.append((len(self.edges) + 1, self.ids[src], self.ids[dst], relation))
        self.edge_sources += [(len(self.edges), c, x) for c, x in zip(chunks, confidence or [None] * len(chunks))]
        return len(self.edges)

    def walks(self, spark, accesses, relations=None):
        table = lambda rows, schema: spark.createDataFrame(rows, schema)
        return W.Walks(
            table([(i, *a) for i, a in accesses.items()], "walk_id long, all_chunks boolean, collections array<long>, documents array<long>, denied array<long>"), table(CHUNKS, "chunk_id long, document_id long, collection_id long"),
            table(self.node_sources, "node_id long, chunk_id long, confidence double, surface_name string"), table(self.edges, "edge_id long, src long, dst long, relation string"), table(self.edge_sources, "edge_id long, chunk_id long, confidence double"), relations,
        )

    def run(self, spark, seeds, accesses, hops=2, budget=50, relations=None):
        """Names by depth, edges and truncation of each walk."""
        w = self.walks(spark, accesses, relations)
        seeds = spark.createDataFrame([(i, self.ids[s]) for i in accesses for s in seeds], "walk_id long, node_id long")
        reached = w.reach(seeds, hops, budget)
        edges = w.edges_among(reached, hops)
        back = {v: k for k, v in self.ids.items()}
        out = {i: {"depths": {}, "edges": [], "truncated": False} for i in accesses}
        for r in reached.collect():
            out[r.walk_id]["depths"][back[r.node_id]] = r.depth
            out[r.walk_id]["truncated"] = r.truncated
        for r in edges.orderBy("walk_id", "k").collect():
            out[r.walk_id]["edges"].append((r.edge_id, r.walked_as, r.reversed, r.confidence, r.chunk_ids))
        for r in w.empty_reasons(seeds, reached, edges).collect():
            out[r.walk_id]["reason"] = r.reason
        return out


def test_denied_edges_and_nodes(spark):
    g = Graph()
    g.entity("ada", "grace", "linus", "ken")
    g.entity("eve", chunks=(SECRET,))
    g.edge("ada", "REPORTS_TO", "grace", (SECRET,))
    g.edge("grace", "REPORTS_TO", "linus")
    g.edge("ada", "REPORTS_TO", "ken")
    g.edge("ken", "REPORTS_TO", "eve")
    g.edge("ada", "OWNS", "linus", (OPEN, SECRET, OPEN2), (0.4, 0.9, None))
    found = g.run(spark, ["ada"], {1: ALL, 2: RESTRICTED, 3: (False, [2], None, None), 4: (False, None, [1], None), 5: (None, None, None, None)}, 3)
    assert found[1]["depths"] == {"ada": 0, "grace": 1, "linus": 1, "ken": 1, "eve": 2}
    assert found[2]["depths"] == {"ada": 0, "ken": 1, "linus": 1}
    assert found[1]["edges"][-1] == (5, "OWNS", False, 0.9, [1, 2, 3]) and found[2]["edges"] == [(3, "REPORTS_TO", False, None, [1]), (5, "OWNS", False, 0.4, [1, 3])]
    assert found[3] == {"depths": {}, "edges": [], "truncated": False, "reason": "no_entity_matched"} == found[5]
    assert found[4]["edges"][-1] == (5, "OWNS", False, 0.4, [1])
    assert [found[i]["reason"] for i in (1, 2)] == [None, None]


def test_a_denied_seed_is_not_reached(spark):
    g = Graph()
    g.entity("ada", chunks=(SECRET,))
    g.entity("grace")
    g.edge("ada", "REPORTS_TO", "grace")
    assert g.run(spark, ["ada", "grace"], {1: RESTRICTED})[1] == {"depths": {"grace": 0}, "edges": [], "truncated": False, "reason": "no_walkable_edges"}


def test_directions_and_inverse_names(spark):
    g = Graph()
    g.entity("platform", "acme", "boss")
    g.edge("platform", "BELONGS_TO", "acme")
    g.edge("acme", "REPORTS_TO", "boss")
    found = g.run(spark, ["acme"], {1: ALL}, 1)[1]
    assert found["edges"] == [(1, "CONTAINS", True, None, [1]), (2, "REPORTS_TO", False, None, [1])]
    assert g.run(spark, ["boss"], {1: ALL}, 3)[1]["edges"] == []
    both = g.run(spark, ["acme", "platform"], {1: ALL}, 1)[1]
    assert both["edges"][0] == (1, "BELONGS_TO", False, None, [1])  # ahead is preferred
    assert g.run(spark, ["acme"], {1: ALL}, 2, relations=["REPORTS_TO"])[1]["depths"] == {"acme": 0, "boss": 1}


def test_hop_limit_cycle_hub_and_budget(spark):
    g = Graph()
    g.entity("hub", *(f"n{i}" for i in range(30)), "far")
    for i in range(30):
        g.edge("hub", "OWNS", f"n{i}")
    g.edge("n0", "OWNS", "n1")
    g.edge("n1", "OWNS", "hub")
    g.edge("n29", "OWNS", "far")
    one = g.run(spark, ["hub"], {1: ALL}, 1)[1]
    assert len(one["depths"]) == 31 and not one["truncated"] and 31 not in [e[0] for e in one["edges"]]
    few = g.run(spark, ["hub"], {1: ALL, 2: RESTRICTED}, 2, 5)
    assert few[1] == few[2] and list(few[1]["depths"]) == ["hub", "n0", "n1", "n2", "n3"] and few[1]["truncated"]
    exact = g.run(spark, ["hub"], {1: ALL}, 2, 32)[1]
    assert exact["depths"]["far"] == 2 and not exact["truncated"]
    with pytest.raises(ValueError, match="hops"):
        g.run(spark, ["hub"], {1: ALL}, 5)


def brute_walk(g, seeds, access, hops, budget):
    allowed, collections, documents, denied = access
    chunk = {c: (d, k) for c, d, k in CHUNKS}
    ok = lambda c: (allowed or chunk[c][1] in (collections or []) or chunk[c][0] in (documents or [])) and chunk[c][0] not in (denied or [])
    nodes = {n for n, c, *_ in g.node_sources if ok(c)}
    sources = {}
    for e, c, x in g.edge_sources:
        if ok(c):
            sources.setdefault(e, []).append((c, x))
    depth = {s: 0 for s in seeds if s in nodes}
    for d in range(hops):
        for e, s, t, r in g.edges:
            if e in sources:
                for a, b in [(s, t)] + [(t, s)] * (r in W.INVERSES):
                    if depth.get(a) == d and b in nodes and b not in depth:
                        depth[b] = d + 1
    kept = dict(sorted(depth.items(), key=lambda x: (x[1], x[0]))[:budget])
    edges = []
    for e, s, t, r in g.edges:
        if e in sources and s in kept and t in kept and (kept[s] < hops or (kept[t] < hops and r in W.INVERSES)):
            back = kept[s] >= hops
            edges.append((e, W.INVERSES[r] if back else r, back, max([x for _, x in sources[e] if x is not None], default=None), sorted({c for c, _ in sources[e]})))
    return kept, edges, len(depth) > budget


def test_random_walks(spark):
    rng = random.Random(4)
    g = Graph()
    for i in range(25):
        g.entity(f"n{i}", chunks=rng.sample([1, 2, 3], rng.choice([1, 2])))
    for _ in range(70):
        chunks = rng.sample([1, 2, 3], rng.choice([1, 2]))
        g.edge(f"n{rng.randrange(25)}", rng.choice(["REPORTS_TO", "OWNS", "RELATED_TO", "MEMBER_OF"]), f"n{rng.randrange(25)}", chunks, [rng.choice([None, 0.3, 0.8]) for _ in chunks])
    accesses = {1: ALL, 2: RESTRICTED, 3: (False, [1], None, [3]), 4: (False, None, [2], None)}
    for hops, budget in ((1, 50), (2, 6), (4, 50)):
        found = g.run(spark, ["n1", "n2"], accesses, hops, budget)
        for i, access in accesses.items():
            kept, edges, truncated = brute_walk(g, [g.ids["n1"], g.ids["n2"]], access, hops, budget)
            assert ({g.ids[n]: d for n, d in found[i]["depths"].items()}, found[i]["edges"], found[i]["truncated"]) == (kept, edges, truncated)


NODES = [(1, "Platform Team"), (2, "Engineering"), (3, "CTO"), (4, "Atlas"), (5, "atlas"), (6, "Platform"), (7, "C++"), (8, ".NET"), (9, "...")]
EDGES = [(1, 2, 3, [10]), (2, 1, 2, [11, 12]), (3, 4, 3, [13]), (4, 5, 1, [14])]  # k, src, dst, chunks
PASSAGES = [(1, 10, "Engineering reports to the CTO."), (2, 11, "Engineering has teams."), (3, 12, "The Platform Team belongs to engineering"), (4, 13, "Atlassian and the CTO"), (5, 14, "Atlas, by the platform team")]
CLAIMS = [
    "Engineering reports to the CTO [E 1][1].", "Engineering reports to the CTO [1].", "Engineering reports to the CTO [E9][1].", "engineering reports to the cto [e 1] [2]", "Engineering reports to the CTO [E 1]", "Platform Team is in Engineering [E2][2]",
    "Platform Team is in Engineering [E2][2][3]", "Platform Team and Engineering report to the CTO [E 1][1]", "Platform Team, in Engineering, reports to the CTO [E1][E2][1][3]", "Atlas shipped in May [1]", "Atlas is owned by the CTO [E3][4]", "Atlas is of the Platform Team [E4][5]",
    "nothing [E 1]", "", None, "Platform [1]", "Platform and the Platform Team [E2]", "C++ and .NET", "C++.NET", "x.NET C++y", "[E 99999999999] CTO", "[E 0]", "the ... and Atlas", "Atlas [E 1] CTO [E 3][4][1]",
]


def brute_mentions(text, nodes):
    text = key(re.sub(r"(?i)\[(?:E\s*)?\d+\]", " ", text))
    by = {}
    for i, n in nodes:
        if key(n):
            by.setdefault(key(n), set()).add(i)
    taken, found = [False] * len(text), []
    for n in sorted(by, key=lambda n: -len(n)):
        hit = False
        for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * len(n)
                hit = True
        if hit:
            found.append(by[n])
    return found


def brute_claim(claim):
    claim = claim or ""
    marks = [int(k) for k in re.findall(r"(?i)\[E\s*(\d+)\]", claim)]
    found = brute_mentions(claim, NODES)
    if not marks and len(found) < 2:
        return False, None
    if any(not 1 <= k <= len(EDGES) for k in marks):
        return True, C.REASONS[0]
    ids = set().union(*found)
    joining = [EDGES[k - 1] for k in dict.fromkeys(marks) if {EDGES[k - 1][1], EDGES[k - 1][2]} <= ids]
    if not joining:
        return True, C.REASONS[1]
    cited = [PASSAGES[n - 1] for n in map(int, re.findall(r"\[(\d+)\]", claim)) if 1 <= n <= len(PASSAGES)]
    for failing in (2, 3):
        for _, s, d, chunks in joining:
            sources = [p for p in cited if p[1] in chunks]
            if failing == 2 and not sources:
                return True, C.REASONS[2]
            if failing == 3 and not any({s, d} <= set().union(*brute_mentions(p[2], [n for n in NODES if n[0] in (s, d)])) for p in sources):
                return True, C.REASONS[3]
    covered = {x for _, s, d, _ in joining for x in (s, d)}
    return (True, None) if all(f & covered for f in found) else (True, C.REASONS[4])


def test_graph_claims(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    claims = d([(1, i, c) for i, c in enumerate(CLAIMS)] + [(2, 0, "Engineering and the CTO [E 1][1]")], "walk_id long, claim_id long, text string")
    found = C.judged(claims, d([(1, *n) for n in NODES], "walk_id long, node_id long, name string"), d([(1, *e) for e in EDGES], "walk_id long, k int, src long, dst long, chunk_ids array<long>"), d([(1, *p) for p in PASSAGES], "walk_id long, n int, chunk_id long, text string"))
    got = {(r.walk_id, r.claim_id): (r.is_relation, r.reason) for r in found.collect()}
    assert got.pop((2, 0)) == (True, C.REASONS[0])  # a walk without edges
    assert [(c, got[1, i]) for i, c in enumerate(CLAIMS) if got[1, i] != brute_claim(c)] == []
    assert {r for _, r in got.values()} == {None, *C.REASONS}


def test_named_takes_the_longest(spark):
    rows = spark.createDataFrame([("platform team alpha beta", ["platform team", "team alpha beta", "beta", "alpha"])], "t string, n array<string>")
    assert rows.select(C.named(name_key("t"), "n" and rows["n"])).collect()[0][0] == ["team alpha beta"]


def test_a_hub_is_met_with_the_documents_that_decide(spark):
    g = Graph()
    g.entity("ada", "grace")
    g.edge("ada", "OWNS", "grace")
    many = spark.range(100, 400).selectExpr("id AS chunk_id", "id % 150 AS document_id", "id % 2 AS collection_id")
    hub = many.selectExpr("2L AS node_id", "chunk_id", "CAST(NULL AS DOUBLE) AS confidence", "'grace' AS surface_name")
    accesses = {1: (False, [0], None, [0, 2]), 2: (False, [0], None, None), 3: (True, None, None, [1]), 4: (False, [7], None, None)}
    w = g.walks(spark, accesses)
    w.node_sources, w.chunks = w.node_sources.where("node_id = 1").unionByName(hub), w.chunks.unionByName(many)
    assert w.enough == 3 and w.nodes.where("node_id = 2").count() == 2 * 3  # not 300
    asked = spark.createDataFrame([(i, 2) for i in accesses], "walk_id long, node_id long")
    assert sorted(r.walk_id for r in w.seen_nodes(asked).collect()) == [1, 2, 3]
    all_denied = g.walks(spark, {1: (False, [0], None, list(range(0, 150, 2))), 2: (False, [0], None, list(range(2, 150, 2))), 3: (False, None, [149], None)})
    all_denied.node_sources, all_denied.chunks = hub, many
    assert sorted(r.walk_id for r in all_denied.seen_nodes(asked).collect()) == [2, 3]


def test_names_that_a_text_has_not_cost_no_patterns(spark):
    names = [f"part number {i}" for i in range(50)] + ["x\x02"]
    rows = spark.range(1000).select(F.concat(F.lit("part number "), (F.col("id") % 60).cast("string"), F.lit(" and .net x")).alias("t"), F.array(*map(F.lit, names), F.lit(".net")).alias("n"))
    start = time.time()
    found = rows.select(F.size(C.named(F.col("t"), F.col("n"))).alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in found} == {1: 160, 2: 840}  # .net, and the number if there is one of it
    assert time.time() - start < 12  # each name's pattern against each text took longer


def test_a_hub_is_spelt_by_the_documents_that_decide(spark):
    g = Graph()
    g.entity("ada", "grace")
    many = spark.range(100, 400).selectExpr("id AS chunk_id", "id % 150 AS document_id", "id % 2 AS collection_id")
    hub = many.selectExpr("2L AS node_id", "chunk_id", "CASE WHEN chunk_id % 7 > 0 THEN chunk_id % 50 / 50 END AS confidence", "concat('grace ', chunk_id) AS surface_name")
    accesses = {1: (False, [0], None, [48, 98]), 2: (False, [0], None, None), 3: (True, None, None, [49, 148]), 4: (False, [7], None, None)}
    w = g.walks(spark, accesses)
    w.node_sources, w.chunks = w.node_sources.where("node_id = 1").unionByName(hub), w.chunks.unionByName(many)
    assert w.spellings.where("node_id = 2").count() == 2 * 3  # not 300
    rows = [(c, c % 150, c % 2, c % 50 / 50 if c % 7 else None) for c in range(100, 400)]
    want = {}
    for i, (every, collections, _, denied) in accesses.items():
        own = [r for r in rows if (every or r[2] in (collections or [])) and r[1] not in (denied or [])]
        if own:
            want[i] = f"grace {max(own, key=lambda r: (r[3] is not None, r[3] or 0.0, -r[0]))[0]}"
    asked = spark.createDataFrame([(i, 2) for i in accesses], "walk_id long, node_id long")
    assert {r.walk_id: r.name for r in w.names(asked).collect()} == want


def test_sources_that_know_their_documents_and_edges(spark):
    rng = random.Random(3)
    g = Graph()
    g.entity(*"abcdefgh", chunks=(OPEN, SECRET, OPEN2))
    for _ in range(25):
        a, b = rng.sample("abcdefgh", 2)
        g.edge(a, rng.choice(["OWNS", "REPORTS_TO"]), b, tuple(rng.sample([OPEN, SECRET, OPEN2], 2)), (rng.choice([None, 0.5]), 0.25))
    accesses = {1: ALL, 2: RESTRICTED, 3: (False, [1], None, None), 4: (False, [2], None, [3])}
    for relations in (None, ["OWNS"]):
        joined, w = g.walks(spark, accesses, relations), g.walks(spark, accesses, relations)
        full = spark.createDataFrame(g.edge_sources, "edge_id long, chunk_id long, confidence double").join(spark.createDataFrame(g.edges, "edge_id long, src long, dst long, relation string"), "edge_id")
        known = W.Walks(w.walks, w.chunks.where("false"), w.node_sources.join(w.chunks, "chunk_id"), None, full.join(w.chunks, "chunk_id"), relations)  # nothing is left to join
        seeds = spark.createDataFrame([(i, 1) for i in accesses], "walk_id long, node_id long")
        rows = []
        for x in (joined, known):
            reached = x.reach(seeds)
            read = x.edges_among(reached)
            rows.append((sorted(map(tuple, reached.collect())), sorted(map(str, read.collect())), sorted(map(tuple, x.names(reached).collect()))))
        assert rows[0] == rows[1] and rows[0][1]
