import re

import corpus_pipeline as C
from siftwell.llm import toxicity

from . import test_bpe, test_decontaminate, test_similar, test_substrings


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(C.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = before, docs
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {name: dict(x[0]) for name, x in seen.items()}

    before, first = seen["toxicity"]
    scores = {r.doc_id: r.s for r in toxicity.score(first, toxicity.fitted(first, spark.read.parquet(f"{sf}/labels.parquet")), "s").collect()}
    assert set(kept["ngram_jaccard_join"]) == {d for d, _ in before if scores[d] < 0.5}
    before, _ = seen["ngram_jaccard_join"]
    assert set(kept["substring_dedup"]) == {d for d, _, c in test_similar.brute(before) if d == c}
    before, _ = seen["substring_dedup"]
    for d, n, gone, digest in test_substrings.brute(before):
        now = kept["benchmark_decontamination"][d]
        assert len(re.findall(r"[^\x20\x09-\x0D]+", now)) == n - gone
        assert gone or now == kept["substring_dedup"][d]
    before, _ = seen["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(kept["byte_bpe"]) == {r[0] for r in test_decontaminate.brute(before, items) if not r[-1]}
    assert sorted(map(tuple, docs.collect())) == sorted(test_bpe.brute(seen["byte_bpe"][0]))
    counts = [len(x) for x in kept.values()]
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4]


def test_edges(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5), (4, "a  b", "de", "s", 4), (3, "A B", "en", "s", 3)]
    names = "doc_id long, text string, lang string, source string, n_chars long, {} string, of_doc int, keep int, score int, kept int, root int"
    rows = [(*r, "u", 1, 2, 3, 4, 5) for r in rows]
    docs = spark.createDataFrame(rows, names.format("uid"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(C.STAGES):
            now = stage(spark, now, "/root/testdata/sf0.001")
            if k < len(C.STAGES) - 1:
                assert now.columns == docs.columns
                assert all(r.uid == "u" and (r.of_doc, r.keep, r.score, r.kept, r.root) == (1, 2, 3, 4, 5) for r in now.collect())
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in now.collect())
        assert [x[:2] for x in got] == ([] if empty else [(False, 0), (True, 1), (True, 2), (True, 2), (True, 3)])
