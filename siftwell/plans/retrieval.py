"""Queries of retrieval: lexical and vector rankings, fusion, boosts, budgets, access, routing and whole strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import signals as S
from siftwell.functions import text as T
from siftwell.operators import access as A
from siftwell.operators import ranking as R
from siftwell.operators.agent import run_agents
from siftwell.operators.fulltext import PositionalIndex, full_text
from siftwell.operators.lineage import cut, folder, version
from siftwell.operators.passages import passages
from siftwell.operators.repair import MOST
from siftwell.plans.registry import QUESTIONS_SQL, WORDINGS, WORDINGS_SQL, query, questions, table
from siftwell.plans.text import _CONTENT

_BASE = f"""q AS (SELECT query_id, question FROM {QUESTIONS_SQL}),
 qt AS (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q),
 qd AS (SELECT query_id, term, count(*) AS m FROM qt GROUP BY 1, 2),
 d AS (SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
 p AS (SELECT doc_id, source, lang, len(ts) AS dl, unnest(ts) AS term FROM d),
 tf AS (SELECT doc_id, source, lang, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qd) GROUP BY 1, 2, 3, 4, 5),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 st AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS avgdl FROM d WHERE len(ts) > 0)"""
_PART = "ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


def _bm25(k: int, where: str = "true", weight: str = "1", name: str = "bm") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, round(sum({weight} * {_PART}), 6) AS score FROM tf JOIN qd USING (term) JOIN df USING (term), st WHERE {where} GROUP BY 1, 2) WHERE score > 0) WHERE rank <= {k})"""


def _overlap(k: int) -> str:
    return f"""ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(count(*) / max(s.q), 6) AS score FROM tf JOIN qd USING (term) JOIN (SELECT query_id, count(*) AS q FROM qd GROUP BY 1) s USING (query_id) GROUP BY 1, 2)) WHERE rank <= {k})"""


def _rrf(wb: float, wo: float, k: int, name: str = "rr") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(sum(part), 6) AS score FROM (SELECT query_id, doc_id, {wb} / (60 + rank) AS part FROM bm UNION ALL SELECT query_id, doc_id, {wo} / (60 + rank) FROM ov) GROUP BY 1, 2)) WHERE rank <= {k})"""


_IDS = "list_filter(regexp_extract_all(question, '[A-Za-z0-9_](?:[A-Za-z0-9_.\\-]*[A-Za-z0-9_])?'), lambda t: " + " OR ".join(f"regexp_matches(t, '{f}')" for f in S.IDENTIFIER_FORMS) + ")"
_PHRASES = "list_transform(regexp_extract_all(question, '\"[^\"]+\"|“[^”]+”'), lambda p: substr(p, 2, length(p) - 2))"


def _boost(source: str, k: int) -> str:
    has = lambda xs: f"len(list_filter({xs}, lambda x: contains(lower(d.text), lower(x)))) > 0"
    return f"""bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(h.score * CASE WHEN {has(_PHRASES)} THEN 2.0 ELSE 1.0 END * CASE WHEN {has(_IDS)} THEN 3.0 ELSE 1.0 END, 6) AS score
      FROM {source} h JOIN d USING (doc_id) JOIN q USING (query_id))) WHERE rank <= {k})"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_indexes: dict[tuple, object] = {}


def _kept(spark, sf_dir, kind):
    """The stored index of the documents as they are, written by the first query of a session that asks for it."""
    key = (kind, spark.sparkContext.applicationId, version(spark, f"{sf_dir}/documents.parquet"))
    if key not in _indexes:
        _indexes[key] = kind(_docs(spark, sf_dir), folder(spark, "index"))
    return _indexes[key]


def _index(spark, sf_dir) -> R.Index:
    return _kept(spark, sf_dir, R.Index)


@query("rk03_full_text")
def english_full_text(spark, sf_dir):
    """Benchmark passages as questions, against all documents: texts with all stems of a passage, by cover density. SQL has no stems."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return full_text(_kept(spark, sf_dir, PositionalIndex), asked)


@query("ag01_term_stats", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def term_stats(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query("ag01_corpus_stats", "SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS sum_len FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents) WHERE n > 0")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(_docs(spark, sf_dir))


@query(
    "ag01_incremental",
    """WITH t AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents WHERE lang <> 'de')
    SELECT term, count(*) AS df FROM t GROUP BY term""",
)
def incremental_stats(spark, sf_dir):
    """Everything indexed, then German documents removed again by negative deltas; terms that fall to zero go."""
    rows = _docs(spark, sf_dir).select("lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    deltas = rows.select("term", F.lit(1).alias("d")).unionByName(rows.where("lang = 'de'").select("term", F.lit(-1).alias("d")))
    return deltas.groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")


@query("rk01_bm25", f"WITH {_BASE}, {_bm25(10)} SELECT query_id, rank, doc_id, score FROM bm")
def bm25(spark, sf_dir):
    return R.bm25(_index(spark, sf_dir), questions(spark, sf_dir))


@query("rk01_bm25_filtered", f"WITH {_BASE}, {_bm25(10, where="lang = 'en' AND source NOT IN ('src0', 'src1')")} SELECT query_id, rank, doc_id, score FROM bm")
def bm25_filtered(spark, sf_dir):
    """A metadata filter and an access filter inside the search; statistics stay those of the corpus."""
    return R.bm25(_index(spark, sf_dir), questions(spark, sf_dir), allowed=(F.col("lang") == "en") & ~F.col("source").isin("src0", "src1"))


@query("rk02_bm25_multiplicity", f"WITH {_BASE}, {_bm25(10, weight='m')} SELECT query_id, rank, doc_id, score FROM bm")
def bm25_multiplicity(spark, sf_dir):
    return R.bm25(_index(spark, sf_dir), questions(spark, sf_dir), distinct=False)


@query("rk04_overlap_fts", f"WITH {_BASE}, {_overlap(10)} SELECT query_id, rank, doc_id, score FROM ov")
def overlap(spark, sf_dir):
    return R.overlap(_index(spark, sf_dir), questions(spark, sf_dir))


def _cosine(k: int, threshold: float) -> str:
    return f"""SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
        / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score
      FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b) WHERE score >= {threshold}) WHERE rank <= {k}"""


@query("rk05_cosine_topk", _cosine(5, -2))
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.cosine_top(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("rk05_threshold", _cosine(5, 0.25))
def cosine_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.cosine_top(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), threshold=0.25)


def _legs(spark, sf_dir, k=30):
    q = questions(spark, sf_dir)
    return R.bm25(_index(spark, sf_dir), q, k), R.overlap(_index(spark, sf_dir), q, k)


@query("rk07_rrf", f"WITH {_BASE}, {_bm25(30)}, {_overlap(30)}, {_rrf(1.0, 1.0, 10)} SELECT query_id, rank, doc_id, score FROM rr")
def rrf(spark, sf_dir):
    bm, ov = _legs(spark, sf_dir)
    return R.fuse([(bm, 1.0), (ov, 1.0)])


@query("rk07_rrf_weighted", f"WITH {_BASE}, {_bm25(30)}, {_overlap(30)}, {_rrf(2.0, 0.5, 10)} SELECT query_id, rank, doc_id, score FROM rr")
def rrf_weighted(spark, sf_dir):
    bm, ov = _legs(spark, sf_dir)
    return R.fuse([(bm, 2.0), (ov, 0.5)])


@query("rk08_boosts", f"WITH {_BASE}, {_bm25(30)}, {_boost('bm', 10)} SELECT query_id, rank, doc_id, score FROM bo")
def boosts(spark, sf_dir):
    docs, q = _docs(spark, sf_dir), questions(spark, sf_dir)
    return R.boost(R.bm25(_index(spark, sf_dir), q, 30), docs, q)


@query(
    "rk09_hybrid_norm_sum",
    f"""WITH {_BASE}, {_bm25(20)}, {_overlap(20)}, b AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS lex FROM bm),
    v AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS vec FROM ov),
    j AS (SELECT query_id, doc_id, coalesce(vec, 0.0) AS vec, coalesce(lex, 0.0) AS lex, round(coalesce(vec, 0.0) + coalesce(lex, 0.0), 6) AS hybrid FROM v FULL JOIN b USING (query_id, doc_id))
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank, doc_id, vec, lex, hybrid FROM j) WHERE rank <= 10""",
)
def hybrid(spark, sf_dir):
    bm, ov = _legs(spark, sf_dir, 20)
    return R.hybrid(ov, bm)


@query(
    "rk11_token_budget",
    f"""WITH {_BASE}, {_bm25(10)} SELECT query_id, rank, doc_id, used FROM (SELECT query_id, rank, doc_id,
    CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM bm JOIN documents USING (doc_id)) WHERE used <= 3000""",
)
def token_budget(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.within_tokens(R.bm25(_index(spark, sf_dir), questions(spark, sf_dir)), docs, 3000)


@query(
    "rk12_char_budget",
    f"""WITH {_BASE}, {_bm25(10)} SELECT query_id, rank, doc_id, used FROM (SELECT query_id, rank, doc_id,
    CAST(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM bm JOIN documents USING (doc_id)) WHERE used <= 6000 OR rank = 1""",
)
def char_budget(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.within_characters(R.bm25(_index(spark, sf_dir), questions(spark, sf_dir)), docs, 6000)


@query(
    "rk14_confidence",
    f"""WITH {_BASE}, {_overlap(5)}, qc AS (SELECT query_id, list_distinct({_CONTENT.replace("text", "question")}) AS qs FROM q),
    c AS (SELECT query_id, rank, score, len(list_intersect(qs, ds)) AS met, len(qs) AS n, len(ds) AS m FROM (SELECT query_id, rank, score, qs, list_distinct({_CONTENT}) AS ds FROM ov JOIN documents USING (doc_id) JOIN qc USING (query_id))),
    a AS (SELECT query_id, max(met / n) FILTER (WHERE rank = 1) AS cov, max(least(1.0, greatest(0.0, score) / sqrt(n / greatest(n, m)))) FILTER (WHERE rank = 1) AS rel,
      coalesce(avg(CASE WHEN met >= n / 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank > 1), 0) AS sup FROM c GROUP BY query_id)
    SELECT q.query_id, coalesce(round(0.5 * cov + 0.4 * rel + 0.1 * sup, 4), 0.0) AS confidence FROM q LEFT JOIN a USING (query_id)""",
)
def confidence(spark, sf_dir):
    docs, q = _docs(spark, sf_dir), questions(spark, sf_dir)
    return R.confidence(R.overlap(_index(spark, sf_dir), q, 5), docs, q)


@query("st02_vectorless", f"WITH {_BASE}, {_bm25(30)}, {_overlap(30)}, {_rrf(1.0, 1.0, 30)}, {_boost('rr', 10)} SELECT query_id, rank, doc_id, score FROM bo")
def vectorless(spark, sf_dir):
    docs, q = _docs(spark, sf_dir), questions(spark, sf_dir)
    bm, ov = R.bm25(_index(spark, sf_dir), q, 30), R.overlap(_index(spark, sf_dir), q, 30)
    return R.boost(R.fuse([(bm, 1.0), (ov, 1.0)], 30), docs, q)


_WEIGHTS = """(SELECT {i}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {i})) AS w FROM (SELECT {i}, bucket, count(*) AS c FROM (
  SELECT {i}, CAST(CAST(concat('0x', substr(md5(t),15,2), substr(md5(t),13,2), substr(md5(t),11,2), substr(md5(t),9,2), substr(md5(t),7,2), substr(md5(t),5,2), substr(md5(t),3,2), substr(md5(t),1,2)) AS UBIGINT) % 64 AS BIGINT) AS bucket
  FROM (SELECT {i}, unnest({ts}) AS t FROM {src})) GROUP BY 1, 2))"""


@query(
    "st01_traditional",
    f"""WITH q AS (SELECT query_id, question AS text FROM {QUESTIONS_SQL}), dw AS {_WEIGHTS.format(i="doc_id", ts=_CONTENT, src="documents")}, qw AS {_WEIGHTS.format(i="query_id", ts=_CONTENT, src="q")},
    s AS (SELECT query_id, doc_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (bucket) GROUP BY 1, 2)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.25) WHERE rank <= 5""",
)
def traditional(spark, sf_dir):
    """Hashing embeddings of questions and documents, by products of matrices."""
    own = T.hashed_vectors(questions(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.col("question").alias("text")))
    vectors = T.hashed_vectors(_docs(spark, sf_dir)).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding"))
    found = R.cosine_top(vectors, own.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("embedding")), 5, 0.25)
    return found.select("query_id", "rank", F.col("vec_id").alias("doc_id"), "score")


_SPOKEN = "' ' || trim(regexp_replace(lower(question), '[^a-z0-9'']+', ' ', 'g')) || ' '"
_ASKED = f"asked AS (SELECT conv_id, turn, text || ' ' || {WORDINGS_SQL}[conv_id % 8 + 1] || CASE WHEN turn % 4 = 2 THEN ' and “on the” with The Big Anble-Corp X1 of Paris, who works on it' ELSE '' END AS question FROM conversations WHERE role = 'user')"


def _asked(spark, sf_dir):
    """conv_id, turn, question: all users' turns, whole, with one of the wordings, and now and then more."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    wording = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.col("conv_id") % 8 + 1).cast("int"))
    more = F.when(F.col("turn") % 4 == 2, " and “on the” with The Big Anble-Corp X1 of Paris, who works on it").otherwise("")
    return rows.select("conv_id", "turn", F.concat("text", F.lit(" "), wording, more).alias("question"))


_NAMED = "regexp_matches(w, '^[A-Z]') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in S.NOT_ENTITIES) + "], lower(w)) AND NOT (" + " OR ".join(f"regexp_matches(w, '{f}')" for f in S.IDENTIFIER_FORMS) + ")"
_RELATED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(w, ' ({'|'.join(S.RELATIONS[t])}) ') THEN '{t}' END" for t in sorted(S.RELATIONS)) + "], lambda x: x IS NOT NULL), ',')"
_SIGNALS = f"""{_ASKED}, ew AS (SELECT conv_id, turn, u.w, u.i, {_NAMED.replace("w,", "u.w,").replace("(w)", "(u.w)")} AS named FROM asked, unnest(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9''\\-]*')) WITH ORDINALITY AS u(w, i)),
 er AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS entity, min(i) AS i FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM ew WHERE named) GROUP BY conv_id, turn, run),
 en AS (SELECT conv_id, turn, string_agg(entity, ',' ORDER BY i) AS entities FROM er GROUP BY 1, 2),
 sg AS (SELECT conv_id, turn, question, {_SPOKEN} AS w, len(list_distinct({_IDS})) AS n_identifiers, len({_PHRASES}) AS n_phrases FROM asked),
 s2 AS (SELECT conv_id, turn, n_identifiers, n_phrases, {_RELATED} AS relations, coalesce(entities, '') AS entities,
  regexp_matches(w, ' ({"|".join(S.COMPARISON)}) ') AS comparison,
  regexp_matches(w, ' ({"|".join(S.AGGREGATION)}) ') OR (regexp_extract(w, ' how many ([a-z0-9'']+) ', 1) <> '' AND regexp_extract(w, ' how many ([a-z0-9'']+) ', 1) NOT IN ({", ".join(f"'{m}'" for m in S.MEASURES)})) AS aggregation,
  len(question) - len(replace(question, '?', '')) > 1 AS compound, len(regexp_split_to_array(trim(question), '\\s+')) AS n_words FROM sg LEFT JOIN en USING (conv_id, turn))"""


def _signals(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in S.signal_columns(F.col("question")).items()])


@query("st09_signals", f"WITH {_SIGNALS} SELECT * FROM s2")
def signals(spark, sf_dir):
    return _signals(spark, sf_dir)


_FIRED = "f AS (SELECT *, n_identifiers + n_phrases > 0 AS ex, relations <> '' AND entities <> '' AS re, comparison OR aggregation OR compound AS se, CASE WHEN comparison THEN 'comparison' WHEN aggregation THEN 'aggregation' ELSE 'compound' END AS kind FROM s2)"


@query(
    "st10_router",
    f"""WITH {_SIGNALS}, {_FIRED}, g AS (SELECT *, CAST(ex AS INT) + CAST(re AS INT) + CAST(se AS INT) AS k, CASE WHEN se THEN 'agentic' WHEN ex THEN 'vectorless' WHEN re THEN 'graph' ELSE 'traditional' END AS strategy FROM f)
    SELECT conv_id, turn, strategy, k = 1 OR (k = 0 AND n_words <= 15) AS decisive, k = 1 AS from_rule,
    CASE WHEN k = 1 AND ex THEN 'exact_match' WHEN k = 1 AND re THEN 'relationship' WHEN k = 1 THEN kind WHEN k = 0 AND n_words <= 15 THEN 'simple_factual' ELSE 'ambiguous' END AS query_type,
    CASE WHEN se THEN 'agentic,' || CASE WHEN ex THEN 'vectorless,' ELSE '' END || CASE WHEN re THEN 'graph,' ELSE '' END || 'traditional' || CASE WHEN NOT ex THEN ',vectorless' ELSE '' END || CASE WHEN NOT re THEN ',graph' ELSE '' END
     WHEN ex THEN 'vectorless,' || CASE WHEN re THEN 'graph,traditional' ELSE 'traditional,graph' END || ',agentic' WHEN re THEN 'graph,traditional,vectorless,agentic' ELSE 'traditional,vectorless,graph,agentic' END AS ranking,
    CASE WHEN se THEN 'high' WHEN NOT ex AND re THEN 'medium' ELSE 'low' END AS cost_level FROM g""",
)
def router(spark, sf_dir):
    return _signals(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in S.route().items()])


@query(
    "st10_router_offline",
    f"""WITH {_SIGNALS}, {_FIRED} SELECT conv_id, turn, CASE WHEN ex THEN 'vectorless' ELSE 'traditional' END AS strategy, ex OR re OR se OR n_words <= 15 AS decisive, ex AS from_rule,
    CASE WHEN ex THEN 'exact_match' WHEN re THEN 'relationship' WHEN se THEN kind WHEN n_words <= 15 THEN 'simple_factual' ELSE 'ambiguous' END AS query_type,
    CASE WHEN ex THEN 'vectorless,traditional' ELSE 'traditional,vectorless' END AS ranking, 'low' AS cost_level FROM f""",
)
def router_offline(spark, sf_dir):
    """The same where neither the graph nor the agent can run."""
    return _signals(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in S.route(["traditional", "vectorless"]).items()])


@query(
    "st12_auto_fallback",
    f"""WITH {_BASE}, {_bm25(10)}, {_overlap(10)}, r AS (SELECT query_id, CASE WHEN len({_PHRASES}) + len({_IDS}) > 0 THEN 'vectorless' ELSE 'lexical' END AS want FROM q),
    h AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.9) AS n_first FROM ov GROUP BY 1), b AS (SELECT query_id, count(*) AS n_bm FROM bm GROUP BY 1)
    SELECT query_id, CASE WHEN want = 'vectorless' AND coalesce(n_first, 0) > 0 THEN 'vectorless' ELSE 'lexical' END AS strategy,
    want = 'vectorless' AND coalesce(n_first, 0) = 0 AS fell_back, CASE WHEN want = 'vectorless' AND coalesce(n_first, 0) > 0 THEN n_first ELSE coalesce(n_bm, 0) END AS n_hits
    FROM r LEFT JOIN h USING (query_id) LEFT JOIN b USING (query_id)""",
)
def auto_fallback(spark, sf_dir):
    """Questions with exact wording want nearly complete overlap; those that find none, and all others, go to BM25."""
    docs, q = _docs(spark, sf_dir), questions(spark, sf_dir)
    exact = (F.size(S.phrases(F.col("question"))) + F.size(S.identifiers(F.col("question")))) > 0
    wants = q.select("query_id", exact.alias("exact"))
    first = R.overlap(_index(spark, sf_dir), q, 10).where("score >= 0.9").groupBy("query_id").agg(F.count("*").alias("n_first"))
    other = R.bm25(_index(spark, sf_dir), q, 10).groupBy("query_id").agg(F.count("*").alias("n_bm"))
    rows = wants.join(first, "query_id", "left").join(other, "query_id", "left").fillna(0, ["n_first", "n_bm"])
    served = F.col("exact") & (F.col("n_first") > 0)
    return rows.select("query_id", F.when(served, "vectorless").otherwise("lexical").alias("strategy"), (F.col("exact") & (F.col("n_first") == 0)).alias("fell_back"), F.when(served, F.col("n_first")).otherwise(F.col("n_bm")).alias("n_hits"))


@query("st04_agent_runs")
def agent_runs(spark, sf_dir):
    """What became of each question: rounds, calls, sub-questions answered and given up, evidence, and why it stopped. Rounds are beyond SQL."""
    docs, index = _docs(spark, sf_dir), _index(spark, sf_dir)

    def search(asked):
        rows = cut(asked.withColumn("query_id", F.col("question_id") * 10_000 + F.col("sub_id")))
        sized, tools = R.hint(rows), {"lexical": R.bm25, "overlap": R.overlap}
        hits = [tools[r.tool](index, rows.where(F.col("tool") == r.tool).select("query_id", F.col("query").alias("question")), MOST) for r in rows.select("tool").distinct().collect()]
        hits = reduce(DataFrame.unionByName, hits).join(sized(rows.select("query_id", "question_id", "sub_id", "top_k")), "query_id").where("rank <= top_k")
        return docs.select("doc_id", "text").join(sized(hits), "doc_id").select("question_id", "sub_id", F.col("doc_id").alias("chunk_id"), "text")

    runs = run_agents(questions(spark, sf_dir).withColumnRenamed("query_id", "question_id"), search, tools=["lexical", "overlap"])
    subs = runs.sub_questions.groupBy("question_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("answered", "abandoned", "open")])
    held = runs.evidence.groupBy("question_id").agg(F.countDistinct("chunk_id").alias("n_evidence"))
    rows = runs.ledger.join(subs, "question_id", "left").join(held, "question_id", "left").fillna(0, ["n_answered", "n_abandoned", "n_open", "n_evidence"])
    return rows.select("question_id", "iterations", "calls", "n_answered", "n_abandoned", "n_open", "n_evidence", "stop")


@query("flt01_access_filter", "SELECT doc_id FROM documents WHERE (doc_id IN (1, 2, 3) OR source IN ('src1', 'src2')) AND doc_id NOT IN (2, 12)")
def access_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(A.allowed(F.col("doc_id"), F.col("source"), [1, 2, 3], ["src1", "src2"], [2, 12])).select("doc_id")


_ACCESS = """coll AS (SELECT DISTINCT source FROM documents), users AS (SELECT range AS user_id FROM range(6)),
 grants AS (SELECT source, CAST(substr(source, 4) AS BIGINT) % 3 AS group_id FROM coll WHERE CAST(substr(source, 4) AS BIGINT) % 4 > 0), members AS (SELECT user_id, user_id % 3 AS group_id FROM users),
 seen AS (SELECT source, user_id FROM coll, users WHERE source NOT IN (SELECT source FROM grants) UNION SELECT source, user_id FROM grants JOIN members USING (group_id)),
 readable AS (SELECT user_id, doc_id FROM (SELECT user_id, doc_id FROM documents JOIN seen USING (source) UNION SELECT doc_id % 53, doc_id FROM documents WHERE doc_id % 53 < 6) WHERE doc_id % 50 <> user_id)"""


def _readable(spark, sf_dir):
    """Derived rights: a quarter of the collections is open, others belong to one of three groups; one document in fifty is
    denied to a user, and one in fifty-three is read by right of its own."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("collection_id"))
    users = spark.range(6).select(F.col("id").alias("user_id"))
    number = F.substring("collection_id", 4, 9).cast("long")
    grants = docs.select("collection_id").distinct().where(number % 4 > 0).select("collection_id", (number % 3).alias("group_id"))
    members = users.select("user_id", (F.col("user_id") % 3).alias("group_id"))
    own = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("deny").alias("effect"), (F.col("doc_id") % 50).alias("user_id")), F.struct(F.lit("read").alias("effect"), (F.col("doc_id") % 53).alias("user_id")))).alias("o"))
    overrides = own.select("doc_id", "o.effect", "o.user_id").where("user_id < 6")
    return A.readable(users, docs, grants, members, overrides)


@query("flt02_compute_access", f"WITH {_ACCESS} SELECT user_id, doc_id FROM readable")
def compute_access(spark, sf_dir):
    return _readable(spark, sf_dir)


@query("flt08_access_stats", f"WITH {_ACCESS} SELECT user_id, (SELECT count(*) FROM documents) AS before, count(*) AS after FROM readable GROUP BY user_id")
def access_stats(spark, sf_dir):
    n = _docs(spark, sf_dir).count()
    return _readable(spark, sf_dir).groupBy("user_id").agg(F.lit(n).cast("long").alias("before"), F.count("*").alias("after"))


@query(
    "ag13_leak_test",
    f"""WITH {_ACCESS}, {_BASE}, h AS (SELECT u.user_id, query_id, doc_id, round(sum({_PART}), 6) AS score FROM (SELECT DISTINCT user_id FROM users) u, tf JOIN qd USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3),
    r AS (SELECT user_id, query_id, doc_id FROM (SELECT h.*, row_number() OVER (PARTITION BY h.user_id, query_id ORDER BY score DESC, h.doc_id) AS rank FROM h JOIN readable a ON a.user_id = h.user_id AND a.doc_id = h.doc_id) WHERE rank <= 5)
    SELECT user_id, count(*) AS returned, count(*) FILTER (WHERE (user_id, doc_id) NOT IN (SELECT (user_id, doc_id) FROM readable)) AS forbidden FROM r GROUP BY user_id""",
)
def leak_test(spark, sf_dir):
    """Rankings of each user's own documents; what they hold that the user may not read has to be none. Access is applied to the documents, before any ranking."""
    seen = _readable(spark, sf_dir)
    rows = R.bm25(_index(spark, sf_dir), questions(spark, sf_dir), 5, readers=seen.select(F.col("user_id").alias("reader"), "doc_id")).withColumnRenamed("reader", "user_id")
    checked = rows.join(seen.withColumn("ok", F.lit(1)), ["user_id", "doc_id"], "left")
    return checked.groupBy("user_id").agg(F.count("*").alias("returned"), F.count_if(F.col("ok").isNull()).alias("forbidden"))


@query(
    "flt09_evidence_match",
    "SELECT item_id, doc_id FROM (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS e FROM benchmark) b JOIN (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) d ON contains(t, e)".replace("\\\\", "\\"),
)
def evidence_match(spark, sf_dir):
    """Which documents hold which passages."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.flat(F.col("text")).alias("passage"))
    return passages(_docs(spark, sf_dir).select("doc_id", T.flat(F.col("text")).alias("text")), items)


@query(
    "flt10_identifiers",
    "SELECT doc_id, unnest(list_distinct(" + _IDS.replace("question", "text") + ")) AS token FROM documents",
)
def identifiers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(S.identifiers(F.col("text"))).alias("token"))


@query("flt11_phrases", f"WITH {_ASKED} SELECT conv_id, turn, unnest({_PHRASES}) AS phrase FROM asked")
def phrases(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", F.explode(S.phrases(F.col("question"))).alias("phrase"))
