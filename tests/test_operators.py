"""Hand-made cases of single operators."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.functions import signals as S
from siftwell.functions import text as T
from siftwell.operators import access, evaluate, graph, ranking
from siftwell.sources import parsers, sync


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, question string")


def test_cleaning_and_tokens(spark):
    assert one(spark, T.clean_page, "  a co-\nop\t\tx \n\n\n\n y  ") == "a coop x\n\ny"
    assert one(spark, T.tokens, "It's A-1, é2") == ["it", "s", "a", "1", "2"]
    assert one(spark, T.content_tokens, "what is the limit") == ["limit"]
    assert one(spark, T.content_tokens, "what is it") == ["what", "is", "it"]
    assert sorted(one(spark, T.eval_words, "The 10 days [1], v1.2, and 10.")) == ["10", "days", "v1.2"]


def test_chunks_give_back_their_page(spark):
    text = ("word " * 300 + "\n") * 2 + "\f" + "tail"
    rows = T.chunks(docs(spark, [text, "", None, "   "])).orderBy("doc_id", "chunk_index").collect()
    pages = text.split("\f")
    assert all(pages[r.page - 1][r.char_start : r.char_end] == r.text for r in rows)
    assert {r.doc_id for r in rows} == {1} and rows[-1].page == 2 and [r.chunk_index for r in rows] == list(range(len(rows)))


def test_identifiers_and_phrases(spark):
    text = 'fix ERR_QUOTA_4419 in v2.1.4 for getUserById, RF-4312 and sha256. The gpt-4 "retry limit" of 12 state-of-the-art "open'
    assert one(spark, S.identifiers, text) == ["ERR_QUOTA_4419", "v2.1.4", "getUserById", "RF-4312", "sha256"]
    assert one(spark, S.phrases, text) == ["retry limit"]


def test_bm25(spark):
    corpus = docs(spark, ["retry limit retry", "limit", "ERR_QUOTA_4419 limit", "limit of things", "", None])
    hits = ranking.bm25(ranking.Index(corpus), asked(spark, "quota limit", "nothing here")).collect()
    assert [h.doc_id for h in hits][0] == 3 and {h.query_id for h in hits} == {1} and len(hits) == 4
    n, avgdl = 4, (3 + 1 + 4 + 3) / 4
    part = lambda df, tf, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert hits[0].score == round(part(1, 1, 4) + part(4, 1, 4), 6)
    assert all(h.score > 0 for h in hits)
    assert ranking.bm25(ranking.Index(corpus), asked(spark, "limit"), allowed=F.col("doc_id") != 2).count() == 3
    assert ranking.bm25(ranking.Index(corpus.limit(0)), asked(spark, "limit")).count() == 0


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, r, d) for r, d in enumerate(ids, 1)], "query_id long, rank long, doc_id long")
    a, b = ranked([5, 6, 7]), ranked([6, 9])
    fused = ranking.fuse([(a, 1.0), (b, 1.0)]).collect()
    assert [r.doc_id for r in fused] == [6, 5, 9, 7] and fused[0].score == round(1 / 62 + 1 / 61, 6)
    assert fused == ranking.fuse([(b, 1.0), (a, 1.0)]).collect()


def test_boosts_reorder_and_never_add(spark):
    corpus = docs(spark, ["the limit retry", "the retry limit", "see err_1 now", "other"])
    hits = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 0.9), (1, 3, 3, 0.5)], "query_id long, rank long, doc_id long, score double")
    out = ranking.boost(hits, corpus, asked(spark, '"Retry limit" ERR_1')).collect()
    assert [(r.doc_id, r.score) for r in out] == [(2, 1.8), (3, 1.5), (1, 1.0)]


def test_budgets(spark):
    corpus = docs(spark, ["x" * 400, "x" * 800, "x" * 4])
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, rank long, doc_id long")
    assert [r.doc_id for r in ranking.within_tokens(hits, corpus, 150).collect()] == [1]
    assert [r.doc_id for r in ranking.within_characters(hits, corpus, 10).collect()] == [1]


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "A"), (1, 3, "y"), (1, 4, "B"), (1, 5, "z"), (2, 1, "x"), (4, 1, "q")], "query_id long, rank long, item string")
    sources = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A")], "query_id long, item string")
    got = {r.query_id: tuple(r)[1:] for r in evaluate.retrieval_scores(hits, sources).collect()}
    assert got == {1: (0.4, 1.0, True, 0.5), 2: (0.0, 0.0, False, 0.0), 3: (None, 0.0, False, 0.0)}


def test_access(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, collection_id string")
    see = lambda *x: sorted(r.doc_id for r in d.where(access.allowed(F.col("doc_id"), F.col("collection_id"), *x)).collect())
    assert see() == [1, 2, 3] and see(None, None, [2]) == [1, 3] and see([], []) == [] and see([1], ["b"], [3]) == [1, 2]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = access.readable(
        table([(1,), (2,)], "user_id long"), d, table([("b", 7)], "collection_id string, group_id long"), table([(1, 7)], "user_id long, group_id long"),
        table([(2, 3, "read"), (1, 2, "deny")], "user_id long, doc_id long, effect string"),
    )
    assert sorted(map(tuple, out.select("user_id", "doc_id").collect())) == [(1, 1), (1, 3), (2, 1), (2, 3)]


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2, 10, "OWNS"), (2, 3, 11, "OWNS"), (3, 1, 12, "OWNS"), (4, 1, 13, "REPORTS_TO"), (3, 5, 14, "OWNS"), (5, 6, 15, "OWNS")], "src long, dst long, edge_id long, relation string")
    seeds = spark.createDataFrame([(1,)], "node_id long")
    depth = lambda e, h, denied=None: {r.node_id: r.depth for r in graph.walk(seeds, graph.walk_edges(e, denied), h).collect()}
    assert depth(edges, 1) == {1: 0, 2: 1, 3: 1}  # one-way relations aren't walked back
    assert depth(edges, 3) == {1: 0, 2: 1, 3: 1, 5: 2, 6: 3}
    assert depth(edges, 4, spark.createDataFrame([(3,)], "node_id long")) == {1: 0, 2: 1}
    reached = graph.walk(seeds, graph.walk_edges(edges), 1)
    assert {r.edge_id for r in graph.edges_among(edges, reached, 1).collect()} == {10, 12}  # none between two nodes at the limit


def test_parsers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Üben")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7 x")
    (tmp_path / ".hidden.txt").write_text("no")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:body><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a </w:t></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl><w:p><w:t>Three</w:t></w:p></w:body></w:d>')
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    (tmp_path / "f.pptx").write_bytes(b"broken")
    data, cell = io.BytesIO(), "<a:tc><a:txBody><a:p><a:t>{}</a:t></a:p></a:txBody></a:tc>"
    with zipfile.ZipFile(data, "w") as z:
        shapes = ["<p:sp><p:txBody><a:p><a:t> Title </a:t></a:p><a:p/></p:txBody></p:sp>", f"<p:graphicFrame><a:tbl><a:tr>{cell.format('x')}{cell.format('')}{cell.format('y')}</a:tr></a:tbl></p:graphicFrame>"]
        for n, shape in ((2, shapes[1]), (10, shapes[0]), (1, "".join(shapes))):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:s xmlns:p="u" xmlns:a="v"><p:spTree>{shape}</p:spTree></p:s>')
    (tmp_path / "g.pptx").write_bytes(data.getvalue())
    got = {r.path.rpartition("/")[2]: (r.text, r.status, r.reason) for r in parsers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("café", "accepted", None) and got["b.md"][0] == "# Üben" and got["d.docx"][0] == "One two\nThree\na | b"
    assert got["g.pptx"][0] == "Title\nx | y\fx | y\fTitle"
    assert got["c.txt"][2] == "binary" and got["f.pptx"][2] == "unreadable" and ".hidden.txt" not in got


def test_sync(spark):
    table = lambda rows: spark.createDataFrame(rows, "source_id string, content_hash string")
    now, was = table([("a", "1"), ("b", "2"), ("d", None)]), table([("b", "9"), ("c", "3"), ("d", None)])
    assert {r.source_id: r.status for r in sync.compare(now, was).collect()} == {"a": "added", "b": "updated", "c": "deleted", "d": "unchanged"}
    assert sync.guarded(now.limit(0), was).count() == 0
    assert sorted(map(tuple, sync.upserted(was, table([("b", "5")]), "source_id").collect()), key=str) == [("b", "5"), ("c", "3"), ("d", None)]


def test_stored_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "quota limit limit"), (2, None), (3, "..."), (4, "limit of x")], "doc_id long, text string")
    stored = ranking.Index(rows, f"{tmp_path}/index")
    assert (stored.n, stored.sum_len) == (2, 6)
    asks = asked(spark, "limit quota", "x")
    assert sorted(ranking.bm25(stored, asks).collect()) == sorted(ranking.bm25(ranking.Index(rows), asks).collect())
    assert "PushedFilters: [In(term" in stored.of_terms(ranking.question_terms(asks))._jdf.queryExecution().toString()


def test_cosine_top_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] if i % 9 else [0.0] * 3) for i in range(90)] + [(90, [1.0, 2.0]), (91, None), (92, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 5 = 0 OR vec_id >= 90").select(F.col("vec_id").alias("query_id"), "embedding")

    def cos(a, b):
        if len(a) != len(b):
            return -1.0
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    want = []
    for i, a in rows:
        if a is not None and (i % 5 == 0 or i >= 90):
            best = sorted(((-cos(a, b), j) for j, b in rows if b is not None))[:4]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for size in (1 << 20, 100):
        monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
        assert sorted(map(tuple, ranking.cosine_top(v, q, 4).collect())) == sorted(want)


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_passages(spark, block_bytes):
    from siftwell.operators.passages import passages

    docs = [(1, "the sea is calm"), (2, None), (3, ""), (4, "is is calm sea"), (4, "a b"), (None, "b a")]
    items = [(1, "sea"), (2, "is calm"), (3, ""), (4, None), (5, "sea"), (6, "b"), (6, "a b"), (7, "é")]
    got = passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), block_bytes)
    want = [(i, d) for d, t in docs for i, p in items if t is not None and p is not None and p in t]
    by = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by)
