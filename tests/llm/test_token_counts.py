from collections import Counter

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from siftwell.llm import bpe
from siftwell.llm import token_counts as T

TOKENS, PATTERN = bpe.vocabulary()
BYTE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
N = {
    "chars4-1": lambda t: -(-len(t) // 4),
    "word_bpe_49k": lambda t: len(WORD.encode(t, add_special_tokens=False).ids),
    "byte_bpe_multi_50k": lambda t: len(BYTE.encode_ordinary(t)),
}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def brute(rows, versions):
    docs, tokens = Counter(), Counter()
    for _, text, lang, source in rows:
        for v in versions:
            docs[source, lang, v] += 1
            tokens[source, lang, v] += N[v](text or "")
    return {k: (docs[k], tokens[k]) for k in docs}


def test_signed_batches(spark, tmp_path):
    rows = [(1, "a b. c", "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (4, "é, ü!", "de", None), (5, "x  " * 50000, "en", "s"), (1, "a b. c", "en", "s")]
    d = T.counted(spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_docs int, tokenizer string"))
    rollup = T.Rollup(spark, f"{tmp_path}/r")
    assert totals(rollup) == {}
    versions = list(N)
    assert rollup.commit("a", T.signed(d, versions)) and not rollup.commit("a", T.signed(d, versions))
    assert totals(rollup) == brute(rows, versions)
    gone = d.where("doc_id = 4")
    rollup.commit("b", T.signed(gone, versions, -1))
    rollup.commit("b", T.signed(gone, versions, -1))
    assert totals(rollup) == brute([r for r in rows if r[0] != 4], versions)
    rollup.commit("c", T.signed(gone, versions))
    assert totals(rollup) == brute(rows, versions)


def test_only_committed_batches_count(spark, tmp_path):
    """What an attempt leaves before it is renamed isn't read; ids are any strings; a base keeps what is in it."""
    d = T.counted(spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string"))
    rollup = T.Rollup(spark, f"{tmp_path}/r")
    rollup.commit("a", T.signed(d, ["chars4-1"]))
    attempt = f"{tmp_path}/r/attempts/x"
    rollup.totals().write.parquet(attempt)
    assert totals(rollup) == {("s", "en", "chars4-1"): (1, 1)}
    ids = ["", "../a", "b/c", "day=1 %2F é", "_x", ".y"]
    for k in ids:
        assert rollup.commit(k, T.signed(d, ["chars4-1"])) and not rollup.commit(k, T.signed(d, ["chars4-1"]))
    assert totals(rollup) == {("s", "en", "chars4-1"): (7, 7)}
    for _ in range(3):
        rollup.compact()
        assert totals(rollup) == {("s", "en", "chars4-1"): (7, 7)}
        assert not any(rollup.commit(k, T.signed(d, ["chars4-1"])) for k in ["a", *ids])
    assert not list((tmp_path / "r" / "batches").iterdir())
    rollup.commit("z", T.signed(d, ["chars4-1"], -1))
    assert totals(rollup) == {("s", "en", "chars4-1"): (6, 6)}


def test_query_on_edges(spark, tmp_path):
    rows = [(3, "q r", "en", "b"), (1, "q r", "fr", "a"), (2, None, "en", "a"), (5, None, "de", "c"), (4, "", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in T.op1_token_rollups(spark, str(tmp_path)).collect()}
    assert got == brute([rows[1], rows[2], rows[4]], ["byte_bpe_multi_50k", "word_bpe_49k"])


def test_whole_table(spark):
    """Against brute force: of equal texts, the row of least doc_id counts, under the real vocabularies."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    firsts = {}
    for r in sorted(rows):
        firsts.setdefault(r[1], r)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in T.op1_token_rollups(spark, sf).collect()}
    assert got == brute(firsts.values(), ["byte_bpe_multi_50k", "word_bpe_49k"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert T.op1_token_rollups(spark, str(tmp_path)).count() == 0
