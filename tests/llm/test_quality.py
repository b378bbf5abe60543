import re

import numpy as np

from siftwell.llm import quality as Q

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(tri) < 3000 else None
    if hit is None:
        n = {}
        for t in tri:
            n[t] = n.get(t, 0) + 1
        hit = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def check(rows, texts):
    for r in rows:
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_whole_table(spark):
    rows = Q.op4_weak_supervision(spark, SF).collect()
    check(rows, dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    kept = [r for r in rows if r.kept]
    assert len(kept) > 0.5 * len([r for r in rows if not r.base_failed])


def test_edges(spark, tmp_path):
    texts = {1: None, 2: "", 3: " \n\n \t ", 4: "a b a b a b a b", 5: "x\nx\n x\nx \n\n\nx", 6: "é#ü $$ <|>", 7: "same line here\n" * 40, 8: "w " * 30000, 9: " ".join(f"word{i}" for i in range(400))}
    d = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, n_words int, kept int")
    d.unionByName(d.where("doc_id = 4")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.op4_weak_supervision(spark, str(tmp_path)).collect()
    assert len(rows) == 10
    check(rows, texts)
    assert {r.doc_id for r in rows if r.kept} == {9}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op4_weak_supervision(spark, str(tmp_path)).count() == 0


def test_em_finds_accuracies():
    """Votes drawn with known accuracies: the estimates come near them, and a weak rule loses to strong ones."""
    rng = np.random.default_rng(1)
    truth = rng.random(40000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.75, 0.6])
    right = rng.random((len(truth), 4)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random(right.shape) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.VoteModel(patterns, counts.astype(float))
    assert np.abs(model.accuracy - accuracy).max() < 0.04
    assert abs(model.share - 0.7) < 0.04
    p = model.posterior(votes)
    assert ((p >= 0.5) == truth).mean() > ((votes.sum(1) > 0) == truth).mean()
