import random
import re
from collections import defaultdict

import pytest

from siftwell.llm import exchange as E
from siftwell.llm import similar as S

SF = "/root/testdata/sf0.001"


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            at[t].append(i)
    for i in range(len(docs)):
        near = defaultdict(int)
        for t in sets[i]:
            for j in at[t]:
                if j < i:
                    near[j] += 1
        for j, n in near.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=key)


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=key)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = result(S.op6_grouped_prefixes(spark, SF))
    assert got == brute(docs)
    assert any(r[0] != r[2] for r in got)


def edited(rng, words, share):
    return " ".join(rng.choice("pqrstu") + str(rng.randrange(999)) if rng.random() < share else w for w in words)


def test_edges(spark):
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(9999)}" for _ in range(n)]
    base, passage = text(200), text(60)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "a b c d e"), (8, "a b c d e f"), (9, "w " * 500), (10, "w " * 7), (None, "a b"), (None, "only here"), (4, "a b"), (11, None)]
    docs += [(100 + i, edited(rng, base, 0.02 * (i % 4))) for i in range(60)]  # near the border of similarity
    docs += [(200 + i, " ".join(text(rng.randrange(5, 40)) + passage + text(rng.randrange(5, 40)))) for i in range(40)]
    docs += [(300 + i, " ".join(passage + text(rng.randrange(12)))) for i in range(40)]
    docs += [(400 + i, " ".join(base[: 200 - 9 * i])) for i in range(12)]  # a chain of links
    docs += [(500, " ".join(text(15000)))]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, class string")
    assert result(S.similar_documents(d)) == brute(docs) == result(S.similar_documents(d, count_links=False))


def test_everything_common(spark, monkeypatch):
    """With hardly any shingle known as common, and in few buckets, results are the same."""
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    docs = [(i, edited(rng, base, 0.015 * (i % 3))) for i in range(50)] + [(90 + i, " ".join(base[i:])) for i in range(0, 60, 3)]
    monkeypatch.setattr(S, "MOST_COMMON", 20)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(S.similar_documents(d)) == brute(docs) == result(S.similar_documents(d, count_links=False))


def test_empty_table(spark):
    for count_links in (True, False):
        assert S.similar_documents(spark.createDataFrame([], "doc_id long, text string"), count_links).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (52, 51), (60, 60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
        want[n] = min(seen)
    assert got == want


def all_links(docs):
    """Rows of (doc_id, number of other sets of a similarity of 0.75 or more)."""
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    kinds = set(sets)
    links = {s: sum(100 * len(s & o) >= 75 * len(s | o) for o in kinds if o != s) for s in kinds}
    return sorted((d, links[s]) for (d, _), s in zip(docs, sets))


@pytest.mark.parametrize("few, block, hot, head", [(16, 64, 12, 64), (2, 4, 12, 64), (2, 4, 5, 3)])
def test_all_links_count(spark, monkeypatch, few, block, hot, head):
    """Texts that are all similar are each linked with all others, copies count once, whatever the blocks."""
    rng = random.Random(4)
    base, other = ([f"{c}{i}" for i in range(150)] for c in "vy")
    docs = [(i, " ".join([*base, f"x{i}"])) for i in range(60)] + [(60 + i, " ".join([*base, f"x{i}"])) for i in range(20)]
    docs += [(100 + i, edited(rng, other, 0.015 * (i % 4))) for i in range(50)]
    docs += [(200 + i, " ".join([*[f"g{k}" for k in range(40)], *([f"h{k}" for k in range(i)])])) for i in range(8)]
    for name, value in (("FEW", few), ("BLOCK", block), ("HOT", hot), ("HEAD", head)):
        monkeypatch.setattr(S, name, value)
    got = S.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = all_links(docs)
    assert sorted((r.doc_id, r.n_links) for r in got) == want
    assert want[0] == (0, 59)
    alone = S.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), count_links=False).collect()
    assert sorted((r.doc_id, r.component_id) for r in alone) == sorted((r.doc_id, r.component_id) for r in got)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute(docs)


def test_copies_are_sent_once_a_group(spark):
    """Copies of a text bring one row of its group's shingles, and their shingles are counted before they are sent."""
    text = " ".join(f"c{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(3000)] + [(3000, "a b c d e f")], "doc_id long, text string").repartition(3)
    cells, levels = S.common_shingles(docs, 8)
    assert len(cells) == 36 and set(levels.tolist()) == {11}
    groups = S.prefix_groups(docs, spark.sparkContext.broadcast((cells, levels)))
    assert sorted(r.n for r in groups.collect()) == [2, 36]
    part = S.pa.RecordBatch.from_pydict({"text": [text] * 3000})
    ones = lambda p: (c := S.Sets(p.column(0)).value, (c % 8).astype("i4"), c, S.np.ones(len(c), "u4"))[1:]
    sent = [E.unpacked(d, ["<u8", "<u4"]) for b in E.sent(S.chunks([part]), ones, S.np.add) for d in b.column(1).to_pylist()]
    assert sum(len(x[0]) for x in sent) == 36 and sum(int(x[1].sum()) for x in sent) == 36 * 3000


def test_rows_of_one_component_are_not_dealt_to_each_other(spark, monkeypatch):
    """Of a shingle's rows, each two of different roots meet under one key, and a large root's rows don't meet each other."""
    rng = random.Random(5)
    rows = [(t, i, root) for t, sizes in enumerate([(900, 3, 2), (30, 20, 1, 1, 2), (1,) * 50, (3, 1)]) for root, k in enumerate(sizes) for i in rng.sample(range(10**6), k)]
    monkeypatch.setattr(S, "BLOCK", 8)
    got = S.dealt(spark.createDataFrame(rows, "token long, node long, root long")).collect()
    assert len(got) == len(rows)
    keys = {}
    for r in got:
        as_a, as_b = {(r.part, j) for j in range(r.after, r.parts)}, {(i, r.part) for i in range(r.before + 1)}
        keys[r.token, r.node, r.root] = as_a, as_b
    for t in range(1, 4):
        own = [(k, v) for k, v in keys.items() if k[0] == t]
        for n, (x, (xa, xb)) in enumerate(own):
            for y, (ya, yb) in own[:n]:
                if x[2] != y[2]:
                    assert len((xa & yb) | (ya & xb)) == 1
    large = [v for k, v in keys.items() if k[0] == 0 and k[2] == 0]
    assert len(large) == 900 and not set.union(*(a for a, _ in large)) & set.union(*(b for _, b in large))
    # with all parts meeting all, 905 rows in 114 parts would be sent 905 * 115 times
    assert sum(len(a) + len(b) for k, (a, b) in keys.items() if k[0] == 0) < 2000


@pytest.mark.parametrize("sets, shingles", [(256, 1 << 20), (7, 1 << 20), (256, 500)])
def test_links_are_counted_in_parts(spark, monkeypatch, sets, shingles):
    """However a component is parted, its links are counted once each, and two parts give a row a set and none a pair."""
    rng = random.Random(6)
    base, other = ([f"{c}{i}" for i in range(150)] for c in "vy")
    docs = [(i, edited(rng, base, 0.012 * (i % 3))) for i in range(60)] + [(100 + i, " ".join([*other, f"x{i % 40}"])) for i in range(50)]
    docs += [(300, "a b c d e f g h i"), (301, "a b c d e f g h i j"), (302, "a b c d e f g h i")]
    monkeypatch.setattr(S, "SETS", sets)
    monkeypatch.setattr(S, "SHINGLES", shingles)
    between, most = S.links_between, spark.sparkContext.accumulator(0)

    def counted(key, table):
        out = between(key, table)
        most.add(int(out.num_rows > table.num_rows))
        return out

    monkeypatch.setattr(S, "links_between", counted)
    got = S.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == all_links(docs)
    assert most.value == 0
