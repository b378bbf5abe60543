import random
import re

from siftwell.operators import mentions as N
from tests.test_resolution import key


def brute(mentions, spellings):
    """mention -> entities and step, one rule after the other over all spellings."""
    sure = lambda ts: len(" ".join(ts)) >= 3 and any(t not in N.FILLER and t not in N.GENERIC for t in ts)
    within = lambda a, b: len(b) > 0 and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
    spoken = [(e, t, key(s), key(s).split()) for e, t, s in spellings if key(s or "")]
    out = {}
    for m, raw, want in mentions:
        k = key(raw or "")
        if not k:
            continue
        core = k.split()
        while core and core[0] in N.FILLER:
            core = core[1:]
        ws = raw.split()
        while ws and ws[0].casefold() in N.FILLER:
            ws = ws[1:]
        written = ws[0].strip(".,;:!?\"'()") if len(ws) == 1 else ""
        short = written.lower() if re.fullmatch("[A-Z]{2,6}", written) else None
        steps = [
            {e for e, t, s, _ in spoken if s == k and want in (None, t)}, {e for e, _, s, _ in spoken if s == k}, {e for e, _, s, _ in spoken if sure(core) and s == " ".join(core)},
            {e for e, _, _, ts in spoken if sure(core) and ((sure(ts) and within(core, ts)) or within(ts, core))}, {e for e, _, _, ts in spoken if short and len(ts) >= 2 and "".join(w[0] for w in ts if w not in N.NO_INITIAL and w[0].isalnum()) == short},
        ]
        found = next(((i + 1, s) for i, s in enumerate(steps) if s), None)
        if found:
            out[m] = found
    return out


SPELLINGS = [
    (1, "person", "Asha Rao"), (2, "team", "Platform Team"), (2, "team", "the Platform Team"), (3, "policy", "BW-7731"), (4, "person", "Chief Technology Officer"), (5, "team", "Customer Order Team"), (6, "product", "Atlas"), (7, "person", "Atlas"), (8, "team", "team"), (9, "policy", "leave policy"),
    (10, "product", "one two three four five six seven eight"), (11, "person", "..."), (12, "person", None), (13, "team", "Head of the Board"), (14, "product", "a (b) c"),
]


def test_ladder(spark):
    rng = random.Random(1)
    names = ["Atlas", "atlas.", "the Platform Team", "our platform team", "Asha", "error BW-7731 of the team", "CTO", "the CTO.", "cto", "team", "the team", "", None, "...", "HB", "one two three four five six seven", "two three four five six seven eight", "three four five six seven nine", "leave", "policy on leave policy", "rao asha", "Order", "C", "(b)", "COT", "an Asha Rao biography"]
    names += [" ".join(rng.choices("the of asha rao platform team order customer atlas CTO leave policy one two three".split(), k=rng.randrange(1, 5))) for _ in range(120)]
    mentions = [(i, n, rng.choice([None, "person", "team"])) for i, n in enumerate(names)]
    found = N.match_mentions(spark.createDataFrame(mentions, "mention_id long, name string, entity_type string"), spark.createDataFrame(SPELLINGS, "entity_id long, entity_type string, surface_name string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.mention_id, (r.step, set()))[1].add(r.entity_id)
    want = brute(mentions, SPELLINGS)
    assert [(mentions[i], got.get(i), want.get(i)) for i in range(len(mentions)) if got.get(i) != want.get(i)] == []
    assert {s for s, _ in got.values()} == {1, 2, 3, 4, 5}


def test_askers_have_their_own_spellings(spark):
    mentions = spark.createDataFrame([(1, 1, "Asha", None), (2, 1, "Asha", None)], "walk_id long, mention_id long, name string, entity_type string")
    spellings = spark.createDataFrame([(1, 5, "person", "Asha Rao"), (2, 6, "person", "asha")], "walk_id long, entity_id long, entity_type string, surface_name string")
    found = N.match_mentions(mentions, spellings, ("walk_id",))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 5, N.WITHIN), (2, 1, 6, N.TYPED)]


def test_initials_that_spell_a_small_word(spark):
    said = spark.createDataFrame([(1, "OR", None), (2, "the OR", None), (3, "or", None)], "mention_id long, name string, entity_type string")
    names = spark.createDataFrame([(7, "tool", "old rod"), (8, "tool", "red bolt")], "entity_id long, entity_type string, surface_name string")
    assert N.match_mentions(said, names).count() == 0
    assert [tuple(r) for r in N.match_mentions(said, names, capitals=True).collect()] == [(1, 7, N.ACRONYM)]


def test_names_of_many_entities_are_met_once(spark, monkeypatch):
    monkeypatch.setattr(N, "LISTED", 10)  # lists and parts of several kinds
    spoken = [(i, t, s) for i in range(300) for t, s in [("part", f"{'red' if i % 4 else 'blue'} rod"), ("tool", "rod")[:2] if i % 30 else ("part", None)]] + [(400, "part", "old rod"), (400, "part", "old rod"), (401, "part", "Red Rod.")]
    said = [(i, n, w) for i, (n, w) in enumerate([("rod", None), ("the red rod", "part"), ("red rod", "part"), ("RED ROD", "tool"), ("RR", None), ("old rod", "part"), ("nothing", None)] * 20)] + [(0, "blue rod", "part")]
    frames = spark.createDataFrame(said, "mention_id long, name string, entity_type string"), spark.createDataFrame(spoken, "entity_id long, entity_type string, surface_name string")
    found = N.match_mentions(*frames)
    got = sorted((r.mention_id, r.entity_id, r.step) for r in found.collect())
    want = brute([(i, *x) for i, (_, *x) in enumerate(said)], spoken)
    both = {}  # the last row is a second spelling of the first mention: of both, the first step that finds any
    for i, (step, es) in want.items():
        m = said[i][0]
        least = min(step, both.get(m, (step,))[0])
        both[m] = (least, (both[m][1] if m in both and both[m][0] == least else set()) | (es if step == least else set()))
    assert got == sorted((m, e, step) for m, (step, es) in both.items() for e in es)
    assert len(got) > 15_000
    rows = lambda node, out: out.append(node) or [rows(node.children().apply(i), out) for i in range(node.children().size())]
    found.write.format("noop").mode("overwrite").save()
    plan, sent = found._jdf.queryExecution().executedPlan(), []
    found.collect()
    nodes = []
    rows(plan.executedPlan() if hasattr(plan, "executedPlan") else plan, nodes)
    stack = list(nodes)
    while stack:
        node = stack.pop()
        if node.nodeName().endswith("QueryStage"):
            inner = []
            rows(node.plan(), inner)
            stack += inner
        written = node.metrics().get("shuffleRecordsWritten")
        if written.isDefined():
            sent.append(written.get().value())
    assert sent and max(sent) < len(got) / 5  # pairs of mentions and entities aren't exchanged
