import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import toxicity as T

SMALL = T.Settings(hidden=3, gram_slots=64, word_slots=32, gram_size=4, word_size=3, attention=2, span=6, step=3)


def test_windows_cover_all_words():
    texts = ["", None, "a", "a b c d e f", "a b c d e f g", " ".join("abcdefghijklmnop"), "!!"]
    x = T.Inputs(pa.array(texts), SMALL)
    assert x.count.tolist() == [1, 1, 1, 1, 2, 5, 1]
    at, inside = x.places(np.arange(len(x.text)))
    seen = [set() for _ in texts]
    for w, text in enumerate(x.text):
        seen[text] |= {int(x.start[w] + k) for k in np.flatnonzero(inside[w])}
    assert [len(s) for s in seen] == [0, 0, 1, 6, 7, 16, 0]


def test_gradients_are_those_of_the_loss():
    x = T.Inputs(pa.array(["one two three four five six seven eight", "", "two two nine ten"]), SMALL)
    net = T.Network(SMALL)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, wanted = np.arange(len(x.text)), np.array([1.0, 0, 0, 1][: len(x.text)])

    def loss():
        q = T.sigmoid(net.logits(x).astype(float))
        return -(wanted * np.log(q) + (1 - wanted) * np.log(1 - q)).mean()

    rng = np.random.default_rng(0)
    for name, g in net.gradients(x, windows, wanted).items():
        for place in rng.choice(g.size, min(g.size, 12), replace=False):
            at = np.unravel_index(place, g.shape)
            was, e = net.p[name][at], 1e-3
            net.p[name][at] = was + e
            up = loss()
            net.p[name][at] = was - e
            down = loss()
            net.p[name][at] = was
            assert (up - down) / (2 * e) == pytest.approx(g[at], abs=2e-4), (name, at)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in T.op3_recurrent_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[d], r.predicted, r.score) for d, r in rows.items() if r.held_out and d in labels]
    assert np.mean([a == b for a, b, _ in held]) > 0.9
    bad, good = ([s for a, _, s in held if a == k] for k in (1, 0))
    assert np.mean([x > y for x in bad for y in good]) > 0.9


def test_edges(spark):
    toxic, fine = "you awful blorg and zarg", "the sea is calm today"
    texts = [f"{fine} {i} {toxic if i % 2 else fine}" for i in range(60)]
    net = T.train(texts, np.arange(60) % 2, T.Settings(batch=16))
    rows = [(1, None), (2, ""), (3, "..."), (4, f"{fine} " * 3000 + toxic), (5, f"{fine} " * 3000), (4, f"{fine} " * 3000 + toxic), (None, toxic)]
    d = spark.createDataFrame([(a, b, 1.0, "x") for a, b in rows], "doc_id long, text string, score double, lang string")
    got = T.score(d, net).collect()
    assert T.score(d, net).columns == ["doc_id", "text", "lang", "score"] == T.score(d, None).columns
    assert len(got) == 7 and got[0].score == got[1].score == got[2].score
    by = {r.doc_id: r.score for r in got}
    assert by[4] >= 0.5 > by[5] and by[None] >= 0.5
    assert {r.score for r in T.score(d, None).collect()} == {0.0}


def test_no_labels_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for name, docs, labels in (("a", d, none), ("b", d.limit(0), spark.createDataFrame([(2, 1, 1), (None, 0, 0), (3, 0, None)], none.schema))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert T.op3_recurrent_toxicity(spark, f"{tmp_path}/{name}").count() == docs.count()


def test_long_labelled_text_leaves_room_for_others(spark):
    """A text longer than the bound isn't learned from and doesn't empty its class; all others are learned from whole, repeated ids too."""
    s = T.Settings()
    first = spark.range(40).orderBy(T.F.xxhash64("id")).first().id
    texts = [(i, f"text {i} is short") for i in range(40)]
    texts[first] = (first, "begin " + "word " * 700_000 + "end")
    texts += [(first, "another text of that id"), (first, "another text of that id"), ((first + 1) % 40, "long " * (s.text_chars // 5))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == first % 2)) for i in range(40)], "doc_id long, toxic int")
    rows = T.labelled_sample(d, labels, s).collect()
    got = [r.text for r in rows]
    assert sorted(got) == sorted({t for _, t in texts if len(t) <= s.text_chars}) and sum(r.toxic for r in rows) == 20


def test_scores_against_a_plain_loop():
    """A text's score from all its overlapping windows, one word at a time."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 31, 32, 33, 48, 49, 200)]
    net = T.train([f"{a} {b}" for a in words[:20] for b in ("bad", "good")], np.tile([1.0, 0.0], 20), T.Settings(batch=16, updates=40))
    p, s = net.p, net.s
    got = net.scores(T.Inputs(pa.array(texts), s))
    x = T.Inputs(pa.array([" ".join(words)]), s)
    vector = dict(zip(words, net.embed(x)[x.word]))

    def gru(inputs, d):
        h, out = np.zeros(s.hidden), []
        for v in inputs:
            g, own = v @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            z, r = (1 / (1 + np.exp(-(g[k : k + s.hidden] + own[k : k + s.hidden]))) for k in (0, s.hidden))
            h = z * h + (1 - z) * np.tanh(g[2 * s.hidden :] + r * own[2 * s.hidden :])
            out.append(h)
        return out

    for text, score in zip(texts, got):
        own, logits, at = text.split(), [], 0
        while True:
            inputs = [vector[w] for w in own[at : at + s.span]]
            states = [np.concatenate(x) for x in zip(gru(inputs, "f"), gru(inputs[::-1], "b")[::-1])]
            weight = np.exp([np.tanh(h @ p["a"] + p["ab"]) @ p["av"] for h in states])
            pooled = sum((w * h for w, h in zip(weight / weight.sum(), states)), np.zeros(2 * s.hidden)) if states else np.zeros(2 * s.hidden)
            logits.append(float(pooled @ p["o"] + p["ob"][0]))
            if at + s.span >= len(own):
                break
            at += s.step
        assert score == pytest.approx(1 / (1 + np.exp(-(net.scale * max(logits) + net.shift))), abs=1e-4)
