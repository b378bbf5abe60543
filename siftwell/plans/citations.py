"""Queries of sentences, claims, support and citations. Answers are made of all assistants' turns: each sentence gets a count of
its letters and a marker, three passages hold the sentences, every fifth in another than the cited one, and some answers are spoilt."""

from __future__ import annotations

from pyspark.sql import functions as F


from siftwell.operators import claims as C
from siftwell.operators import evaluate as E
from siftwell.plans.registry import query, table
from siftwell.plans.text import _CONTENT, _EVAL_STOP

_PIECES = r"regexp_extract_all(text, '(?s).*?(?:[.!?]\s+|\n+)|.+')"
_SPOILT = [" See [9].", "", ' It says "ten full days" [1].', " According to [2] there are 7 days of 2024.", " [1]", ' They wrote "one. two! three [3]'] #: by conversation; the second also loses its markers
_REFUSED = "I could not find that."
_ANSWERS = rf"""s AS (SELECT conv_id, turn, list_filter(list_transform({_PIECES}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ss FROM conversations WHERE role = 'assistant'),
 b AS (SELECT conv_id, turn, list_transform(ss, lambda x, i: regexp_replace(x, '[.!?]+$', '') || ' with ' || length(x) || ' letters') AS bs FROM s),
 c AS (SELECT conv_id, turn, array_to_string(list_transform(bs, lambda x, i: x || ' [' || ((i - 1) % 3 + 1) || '].'), ' ') AS a,
  list_transform([1, 2, 3], lambda j: array_to_string(list_filter(list_transform(bs, lambda x, i: CASE WHEN (CASE WHEN i % 5 = 0 THEN i % 3 ELSE (i - 1) % 3 END) + 1 = j THEN x || '.' END), lambda x: x IS NOT NULL), ' ')) AS contexts FROM b),
 ans AS (SELECT conv_id, turn, contexts, CASE conv_id % 8 WHEN 6 THEN '{_REFUSED}' WHEN 1 THEN regexp_replace(a, '\[[0-9]+\]', '', 'g') WHEN 0 THEN a || '{_SPOILT[0]}' WHEN 2 THEN a || '{_SPOILT[2]}' WHEN 3 THEN a || '{_SPOILT[3]}' WHEN 4 THEN a || '{_SPOILT[4]}' WHEN 5 THEN a || '{_SPOILT[5]}' ELSE a END AS answer FROM c)"""


def _answers(spark, sf_dir):
    """conv_id, turn, answer, contexts."""
    own = F.filter(F.transform(F.regexp_extract_all("text", F.lit(C.PIECE), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", own.alias("ss"))
    rows = rows.withColumn("bs", F.transform("ss", lambda x: F.concat(F.regexp_replace(x, r"[.!?]+$", ""), F.lit(" with "), F.length(x), F.lit(" letters"))))
    holder = lambda i: F.when(i % 5 == 4, (i + 1) % 3).otherwise(i % 3) + 1
    a = F.array_join(F.transform("bs", lambda x, i: F.concat(x, F.lit(" ["), i % 3 + 1, F.lit("]."))), " ")
    held = lambda j: F.transform(F.filter("bs", lambda x, i: holder(i) == j), lambda x: F.concat(x, F.lit(".")))
    contexts = F.array(*[F.array_join(held(j), " ") for j in (1, 2, 3)])
    which, answer = F.col("conv_id") % 8, F.col("a")
    spoilt = F.when(which == 6, _REFUSED).when(which == 1, F.regexp_replace(answer, r"\[[0-9]+\]", ""))
    for k in (0, 2, 3, 4, 5):
        spoilt = spoilt.when(which == k, F.concat(answer, F.lit(_SPOILT[k])))
    return rows.select("conv_id", "turn", a.alias("a"), contexts.alias("contexts")).select("conv_id", "turn", "contexts", spoilt.otherwise(answer).alias("answer"))


_FLAT = r"lower(trim(regexp_replace({t}, '\s+', ' ', 'g')))"
_MS = r"list_transform(regexp_extract_all({t}, '\[([0-9]+)\]', 1), lambda m: CAST(m AS INT))"
_QUOTES = "list_filter(regexp_extract_all({t}, '\"([^\"]+)\"', 1), lambda q: length(q) >= 8 OR regexp_matches(q, '[0-9]'))"


def _violation(t: str) -> str:
    """What SQL has for the contract of an answer or claim in column t, with contexts beside it."""
    ms, flat = _MS.format(t=t), _FLAT.format
    within = f"list_transform(list_filter({ms}, lambda m: m >= 1 AND m <= len(contexts)), lambda m: {flat(t='contexts[m]')})"
    return rf"""CASE WHEN len(list_filter({ms}, lambda m: m < 1 OR m > len(contexts))) > 0 THEN 'marker_out_of_range' WHEN len(contexts) > 0 AND len({ms}) = 0 AND NOT contains(lower({t}), 'could not find') THEN 'uncited'
     WHEN len(list_filter({_QUOTES.format(t=t)}, lambda q: len(list_filter({within}, lambda t: contains(t, {flat(t="q")}))) = 0)) > 0 THEN 'quote_not_found' WHEN NOT regexp_matches(regexp_replace({t}, '\[[0-9]+\]', '', 'g'), '[A-Za-z0-9]') THEN 'no_words' END"""


@query(
    "ct01_markers",
    rf"""WITH {_ANSWERS}, m AS (SELECT conv_id, turn, u.m, min(u.i) AS i FROM ans, unnest(regexp_extract_all(answer, '\[([0-9]+)\]', 1)) WITH ORDINALITY AS u(m, i) GROUP BY 1, 2, 3)
    SELECT conv_id, turn, coalesce(string_agg(m, ',' ORDER BY i), '') AS markers FROM ans LEFT JOIN m USING (conv_id, turn) GROUP BY 1, 2""",
)
def markers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(E.markers(F.col("answer")), ",").alias("markers"))


@query("ct02_contract", f"WITH {_ANSWERS} SELECT conv_id, turn, {_violation('answer')} AS violation FROM ans")
def contract(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", E.contract_violation(F.col("answer"), F.col("contexts")).alias("violation"))


_CLAIMS = r"""pc AS (SELECT conv_id, turn, u.p, u.i, regexp_matches(regexp_replace(u.p, '\[[0-9]+\]', '', 'g'), '[\pL\pN]') OR u.i = 1 AS own FROM ans, unnest(regexp_extract_all(answer, '(?:[^".!?]+|"[^"]*(?:"|\z))+[.!?]?|[.!?]')) WITH ORDINALITY AS u(p, i)),
 pn AS (SELECT conv_id, turn, p, i, sum(CAST(own AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS claim_no FROM pc),
 cl AS (SELECT conv_id, turn, CAST(claim_no AS BIGINT) AS claim_no, string_agg(p, '' ORDER BY i) AS claim FROM pn GROUP BY 1, 2, 3)"""


@query("txt14_claims", f"WITH {_ANSWERS}, {_CLAIMS} SELECT conv_id, turn, claim_no, claim FROM cl")
def claims(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("conv_id", "turn", F.posexplode(C.claims(F.col("answer"))).alias("i", "claim"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("claim_no"), "claim")


@query(
    "ct06_drop_claims",
    rf"""WITH {_ANSWERS}, {_CLAIMS}, j AS (SELECT cl.*, contexts FROM cl JOIN ans USING (conv_id, turn)),
    r AS (SELECT conv_id, turn, claim_no, claim, CASE WHEN regexp_matches(regexp_replace(claim, '\[[0-9]+\]', '', 'g'), '[\pL\pN]') THEN {_violation('claim')} WHEN regexp_matches(claim, '\[[0-9]+\]') THEN 'no_claim' END AS reason FROM j)
    SELECT conv_id, turn, md5(trim(coalesce(string_agg(claim, '' ORDER BY claim_no) FILTER (WHERE reason IS NULL), ''))) AS kept, coalesce(string_agg(reason, ',' ORDER BY claim_no), '') AS reasons FROM r GROUP BY 1, 2""",
)
def drop_claims(spark, sf_dir):
    found = C.drop_unsupported(_answers(spark, sf_dir))
    return found.select("conv_id", "turn", F.md5("kept").alias("kept"), F.array_join(F.col("dropped.reason"), ",").alias("reasons"))


def _words(c: str) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(regexp_replace(lower({c}), '\[[0-9]+\]', ' ', 'g'), '[a-z0-9][a-z0-9\-.,]*[a-z0-9]|[a-z0-9]')), lambda w: NOT list_contains({_EVAL_STOP}, w))"


_JUDGED = r"""sn AS (SELECT conv_id, turn, contexts, unnest(string_split(regexp_replace(answer, '([.!?])\s+([A-Z0-9"(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM ans)"""
_UNSUPPORTED = f"""{_JUDGED}, sw AS (SELECT conv_id, turn, contexts, {_MS.format(t='sentence')} AS ms, {_words('sentence')} AS w FROM sn),
 un AS (SELECT conv_id, turn, count(*) AS n_cited, count(*) FILTER (WHERE len(list_intersect(w, flatten(list_transform(list_filter(ms, lambda m: m >= 1 AND m <= len(contexts)), lambda m: {_words('contexts[m]')})))) / len(w) < 0.5) AS n_unsupported FROM sw WHERE len(ms) > 0 AND len(w) > 0 GROUP BY 1, 2)"""


@query("ct05_sentence_support", f"WITH {_ANSWERS}, {_UNSUPPORTED} SELECT conv_id, turn, coalesce(n_unsupported, 0) AS n_unsupported FROM ans LEFT JOIN un USING (conv_id, turn)")
def sentence_support(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.size(C.unsupported(F.col("answer"), F.col("contexts"))).cast("long").alias("n_unsupported"))


_NORMAL = r"regexp_replace({t}, '([0-9]),([0-9])', '\1\2', 'g')"
_RUN = r"\[[0-9]+\](?:\s*(?:,|and|&)?\s*\[[0-9]+\])*"
_MISPLACED = rf"""{_CLAIMS}, g0 AS (SELECT conv_id, turn, claim_no, regexp_extract_all(claim, '{_RUN}') AS runs, string_split(regexp_replace(claim, '{_RUN}', chr(1), 'g'), chr(1)) AS parts FROM cl),
 g1 AS (SELECT conv_id, turn, claim_no, parts, u.r, u.i, list_transform(regexp_extract_all(u.r, '[0-9]+'), lambda m: CAST(m AS INT)) AS cited FROM g0, unnest(runs) WITH ORDINALITY AS u(r, i)),
 g2 AS (SELECT *, regexp_matches(lower(trim(parts[i])), '(?:passage|passages|source|sources|according to|per|see|from)$') AS ahead FROM g1 WHERE list_min(cited) >= 1 AND list_max(cited) <= 3),
 g3 AS (SELECT conv_id, turn, claim_no, i, cited, CASE WHEN ahead THEN parts[i + 1] ELSE parts[i] END AS segment FROM g2 WHERE trim(parts[1]) <> ''
  UNION ALL SELECT conv_id, turn, claim_no, 1, list_distinct(flatten(list(cited))), array_to_string(any_value(parts), ' ') FROM g2 WHERE trim(parts[1]) = '' GROUP BY 1, 2, 3),
 g4 AS (SELECT *, {_QUOTES.format(t='segment')} AS qs, regexp_replace(segment, '"[^"]+"', ' ', 'g') AS outside FROM g3),
 g5 AS (SELECT conv_id, turn, claim_no, i, cited, unnest(list_distinct(list_concat(list_concat(list_transform(qs, lambda q: '"' || {_NORMAL.format(t=_FLAT.format(t='q'))}), list_transform(regexp_extract_all(outside, '\b[A-Z]{{2,}}-[0-9]+\b'), lambda x: lower(x))),
  list_filter(list_transform(regexp_extract_all(outside, '(?:^|[^\w.,-])([0-9][0-9,]*(?:\.[0-9]+)?(?:\s+[A-Za-z]+)?)', 1), lambda x: lower(regexp_replace(replace(x, ',', ''), '\s+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^(19|20)[0-9][0-9]( |$)'))))) AS phrase FROM g4),
 nt AS (SELECT conv_id, turn, u.k, {_NORMAL.format(t=_FLAT.format(t='u.t'))} AS t FROM ans, unnest(contexts) WITH ORDINALITY AS u(t, k)),
 h AS (SELECT g5.*, k, list_contains(cited, k) AS own FROM g5 JOIN nt USING (conv_id, turn) WHERE CASE WHEN phrase[1] = '"' THEN contains(t, substr(phrase, 2)) ELSE regexp_matches(t, '(?:^|[^0-9.,])' || replace(phrase, '.', '\.') || '(?:[^0-9]|$)') END),
 mi AS (SELECT conv_id, turn, claim_no, i, ltrim(phrase, '"') AS phrase, array_to_string(list_sort(any_value(cited)), ',') AS cited, string_agg(k, ',' ORDER BY k) AS holders FROM h GROUP BY conv_id, turn, claim_no, i, phrase HAVING NOT bool_or(own))"""


@query("ct04_misattribution", f"WITH {_ANSWERS}, {_MISPLACED} SELECT conv_id, turn, phrase, cited, holders FROM mi")
def misattribution(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("conv_id", "turn", F.explode(C.misattributions(F.col("answer"), F.col("contexts"))).alias("m"))
    return rows.select("conv_id", "turn", "m.phrase", F.array_join(F.sort_array("m.cited"), ",").alias("cited"), F.array_join("m.holders", ",").alias("holders"))


@query("ct04_repaired")
def repaired(spark, sf_dir):
    """All answers with misplaced markers moved. The steps of a repair are beyond readable SQL; the tests hold them against a loop."""
    found = C.repaired(_answers(spark, sf_dir))
    show = lambda c, to: F.array_join(F.transform(c, lambda m: F.concat(m["phrase"], F.lit(": "), F.array_join(m["cited"].cast("array<string>"), ","), F.lit(" to "), F.array_join(m[to].cast("array<string>"), ","))), "; ")
    return found.select("conv_id", "turn", F.md5("repaired").alias("repaired"), show(F.col("repairs"), "moved_to").alias("repairs"), show(F.col("unresolved"), "holders").alias("unresolved"))


@query(
    "ct05_citation_check",
    f"""WITH {_ANSWERS}, {_UNSUPPORTED}, {_MISPLACED}, md AS (SELECT DISTINCT conv_id, turn, true AS misplaced FROM mi),
    r AS (SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 'empty' WHEN len({_MS.format(t='answer')}) = 0 AND contains(lower(answer), 'could not find') THEN 'refused_with_passages'
     ELSE coalesce({_violation('answer')}, CASE WHEN len({_MS.format(t='answer')}) = 0 THEN 'uncited' WHEN n_unsupported > 0 THEN 'unsupported' WHEN misplaced THEN 'misattributed' END) END AS reason FROM ans LEFT JOIN un USING (conv_id, turn) LEFT JOIN md USING (conv_id, turn))
    SELECT conv_id, turn, reason, CASE WHEN reason = 'empty' THEN NULL ELSE reason IS NULL END AS correct FROM r""",
)
def citation_check(spark, sf_dir):
    return C.citation_check(_answers(spark, sf_dir)).select("conv_id", "turn", "reason", "correct")


@query(
    "ev02_faithfulness",
    f"""WITH {_ANSWERS}, {_JUDGED}, w AS (SELECT conv_id, turn, flatten(list_transform(contexts, lambda t: {_words('t')})) AS support, {_words('sentence')} AS w FROM sn WHERE conv_id % 8 <> 6)
    SELECT conv_id, turn, round(count(*) FILTER (WHERE len(list_intersect(w, support)) / len(w) >= 0.5) / count(*), 6) AS faithfulness FROM w WHERE len(w) > 0 GROUP BY 1, 2""",
)
def faithfulness(spark, sf_dir):
    """Of the answers against their passages; those that can't be measured are left out."""
    rows = _answers(spark, sf_dir).select("conv_id", "turn", F.round(C.faithfulness(F.col("answer"), F.col("contexts")), 6).alias("faithfulness"))
    return rows.where("faithfulness IS NOT NULL")


_SPANS = r"""sp AS (SELECT {k}, u.i, u.p, sum(length(u.p)) OVER (PARTITION BY {k} ORDER BY u.i) - length(u.p) + length(u.p) - length(regexp_replace(u.p, '^\s+', '')) AS start, regexp_replace(u.p, '^\s+|\s+$', '', 'g') AS sentence
  FROM {src}, unnest(regexp_extract_all(text, '(?s).*?(?:[.!?]\s+|\n+)|.+')) WITH ORDINALITY AS u(p, i))"""


@query("txt13_sentence_spans", f"""WITH {_SPANS.format(k="doc_id", src="documents")} SELECT doc_id, CAST(start AS BIGINT) AS "start", CAST(start + length(sentence) AS BIGINT) AS "end", sentence FROM sp WHERE sentence <> ''""")
def sentence_spans(spark, sf_dir):
    return C.sentence_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "sentence")


_ASKED = "qs AS (SELECT conv_id AS query_id, string_agg(text, ' ' ORDER BY turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1), ch AS (SELECT query_id, rank, text, question FROM (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations WHERE role = 'assistant') JOIN qs USING (query_id)), quoted AS (SELECT * FROM ch WHERE rank <= 3)"


def _chunks(spark, sf_dir):
    """All users' turns of each conversation as its question, the assistant's turns as chunks."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    asked = c.where("role = 'user'").groupBy("query_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("question"))
    rank = F.row_number().over(C.Window.partitionBy("query_id").orderBy("turn"))
    return c.where("role = 'assistant'").select("query_id", rank.alias("rank"), "text").join(asked, "query_id").withColumn("score", F.lit(None).cast("double"))


_SUPPORT = rf"""{_ASKED}, {_SPANS.format(k="query_id, rank, question", src="quoted")},
 b AS (SELECT query_id, rank, start + length(sentence) AS e, regexp_replace(sentence, '^(?:[-*+]|[0-9]+[.)])\s+', '') AS body, list_distinct({_CONTENT.replace("text", "question")}) AS q FROM sp WHERE sentence <> '' AND NOT regexp_matches(sentence, '^#{{1,6}}\s') AND NOT regexp_matches(sentence, '^(?:[-*+]|[0-9]+[.)])$')),
 t AS (SELECT *, e - length(body) AS start, {_CONTENT.replace("text", "body")} AS ws FROM b),
 o AS (SELECT *, len(list_intersect(q, ws)) AS hits, len(list_intersect(q, ws)) / greatest(len(q), 1) - 0.0005::DOUBLE * length(body) AS score FROM t WHERE len(ws) > 0),
 p AS (SELECT *, substr(body, 1, 320) AS head FROM o QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, start) = 1),
 z AS (SELECT *, CASE WHEN length(body) <= 320 THEN length(body) WHEN contains(head, ' ') AND 320 - instr(reverse(head), ' ') > 160 THEN 320 - instr(reverse(head), ' ') ELSE 320 END AS size FROM p WHERE hits >= 1),
 su AS (SELECT query_id, rank, CAST(start AS BIGINT) AS "start", CAST(start + size AS BIGINT) AS "end", substr(body, 1, size) AS text, round(score, 4) AS score FROM z)"""


@query("rk15_extractive_support", f"WITH {_SUPPORT} SELECT * FROM su")
def extractive_support(spark, sf_dir):
    return C.select_support(_chunks(spark, sf_dir))


@query("rk15_extractive_answer", rf"WITH {_SUPPORT} SELECT query_id, 'Based on the most relevant sources: ' || string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM su GROUP BY 1")
def extractive_answer(spark, sf_dir):
    return C.extractive_answers(C.select_support(_chunks(spark, sf_dir)))


@query(
    "ct10_citations",
    rf"""WITH {_SUPPORT}, v AS (SELECT ch.query_id, ch.rank, ch.text, su."start" AS s, su."end" AS e, greatest(0, least(su."start" - floor(greatest(0, 240 - (su."end" - su."start")) / 2), length(ch.text) - 240)) AS l0 FROM ch LEFT JOIN su USING (query_id, rank)),
    l AS (SELECT *, CAST(CASE WHEN s IS NULL THEN 0 WHEN length(text) <= 240 THEN 0 ELSE greatest(0, l0) END AS BIGINT) AS a FROM v)
    SELECT query_id, rank AS marker, s IS NOT NULL AS used, CASE WHEN length(text) <= 240 THEN text ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, 240) || CASE WHEN a + 240 < length(text) THEN '...' ELSE '' END END AS snippet FROM l""",
)
def citations(spark, sf_dir):
    """What is shown of each chunk: its marker, whether it is quoted, and the part around the quote."""
    chunks = _chunks(spark, sf_dir)
    support = C.select_support(chunks).select("query_id", "rank", "start", "end")
    rows = chunks.select("query_id", F.col("rank").cast("long").alias("rank"), "text").join(support, ["query_id", "rank"], "left")
    return rows.select("query_id", F.col("rank").alias("marker"), F.col("start").isNotNull().alias("used"), C.snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


@query(
    "txt20_highlights",
    rf"""WITH {_ASKED}, p AS (SELECT query_id, rank, list_filter({_CONTENT.replace("text", "question")}, lambda t: length(t) >= 3) AS terms, u.i, u.p, sum(length(u.p)) OVER (PARTITION BY query_id, rank ORDER BY u.i) AS e FROM ch, unnest(regexp_extract_all(text, '[^\pL\pN_]*[\pL\pN_]+')) WITH ORDINALITY AS u(p, i)),
    w AS (SELECT query_id, rank, terms, lower(regexp_replace(p, '^[^\pL\pN_]+', '')) AS term, e FROM p) SELECT query_id, rank, term, CAST(e - length(term) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM w WHERE list_contains(terms, term)""",
)
def highlights(spark, sf_dir):
    found = C.highlights(_chunks(spark, sf_dir), ["query_id", "rank"])
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
