"""Sentences, claims and what supports them. Rows of answers hold `answer` and `contexts` (array<string>, in order of rank); all of
it stays in the row, so nothing is shuffled but for offsets of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import content_tokens, eval_words, flat
from siftwell.operators.evaluate import SUPPORT, contract_violation, is_refusal, markers

# Where sentences end, for quoting and for judging; a run of markers that cite one claim; words that point ahead.
PIECE = r"(?sU).*?(?:[.!?]\s+|\n+)|.+"
JUDGED = r"(?<=[.!?])\s+(?=[A-Z0-9\"(])"
MARKER_RUN = r"\[\d+\](?:\s*(?:,|and|&)?\s*\[\d+\])*"
POINTERS = ["passage", "passages", "source", "sources", "according to", "per", "see", "from"]
# Chunks that may be quoted, their least score, the longest quote and snippet, letters of a highlighted term.
QUOTED, LEAST_SCORE, LONGEST_QUOTE, SNIPPET, TERM = 3, 1e-9, 320, 240, 3
#: Fixed value: share of a claim's longer words by which a cited passage keeps its marker.
KEEPING = 0.34
#: What a claim is made of: text between marks, or a quotation, which is never cut; then its closing mark.
CLAIM = r'(?:[^".!?]++|"[^"]*+(?:"|\z))++[.!?]?|[.!?]'


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentence_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each sentence of `text`: other columns, start, end (in characters) and sentence. Null and blank texts have none.

    The keys have to name a row, as offsets are sums over its pieces.
    """
    others = [c for c in rows.columns if c != "text"]
    cut = rows.select(*others, F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("piece_no", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(*keys).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"(?U)^\s+", ""))
    spans = cut.withColumn("start", F.coalesce(before, F.lit(0)) + lead).withColumn("sentence", stripped(F.col("piece"))).where("sentence <> ''")
    return spans.select(*others, "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def select_support(chunks: DataFrame) -> DataFrame:
    """query_id, rank, start, end, text, score of the best sentence of each of the first chunks (query_id, rank, text, score,
    question): the share of the question's content words it has, less a little for length, the earlier of equals.

    Chunks scored zero, and those whose best sentence has no word of the question, give none; a null score says nothing. Headings and bare list
    marks aren't quoted, an item is quoted without its mark, and a long sentence ends at a word.
    """
    asked = F.array_distinct(content_tokens(F.col("question")))
    rows = chunks.where((F.col("rank") <= QUOTED) & (F.col("score").isNull() | (F.col("score") > LEAST_SCORE)))
    spans = sentence_spans(rows.select("query_id", "rank", "text", asked.alias("asked")), ["query_id", "rank"])
    spans = spans.where(~F.col("sentence").rlike(r"^#{1,6}\s") & ~F.col("sentence").rlike(r"^(?:[-*+]|\d+[.)])$"))
    spans = spans.withColumn("body", F.regexp_replace("sentence", r"^(?:[-*+]|\d+[.)])\s+", "")).withColumn("start", F.col("end") - F.length("body"))
    spans = spans.withColumn("words", content_tokens(F.col("body"))).where(F.size("words") > 0)
    spans = spans.withColumn("hits", F.size(F.array_intersect("asked", "words"))).withColumn("score", F.col("hits") / F.greatest(F.size("asked"), F.lit(1)) - 0.0005 * F.length("body"))
    best = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy(F.desc("score"), "start"))
    picked = spans.withColumn("place", best).where("place = 1 AND hits >= 1")
    head = F.substring("body", 1, LONGEST_QUOTE)
    space = F.when(F.contains(head, F.lit(" ")), LONGEST_QUOTE - F.instr(F.reverse(head), " ")).otherwise(-1)  # characters before the last space
    size = F.when(F.length("body") <= LONGEST_QUOTE, F.length("body")).when(space > LONGEST_QUOTE // 2, space).otherwise(LONGEST_QUOTE)
    return picked.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"), (F.col("start") + size).cast("long").alias("end"), F.substring(F.col("body"), F.lit(1), size).alias("text"), F.round("score", 4).alias("score"))


def extractive_answers(support: DataFrame) -> DataFrame:
    """query_id, answer: quotes in order of rank with the markers of their chunks. Questions without support have no row."""
    quote = F.concat(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit(" ["), F.col("rank"), F.lit("]"))
    listed = support.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", quote.alias("quote")))).alias("quotes"))
    return listed.select("query_id", F.concat(F.lit("Based on the most relevant sources: "), F.array_join(F.col("quotes.quote"), " ")).alias("answer"))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The part of a text that is shown, centred on a span (from its beginning if null), with dots where it is cut."""
    left = F.greatest(F.lit(0), start - F.floor(F.greatest(F.lit(0), SNIPPET - (end - start)) / 2))
    left = F.coalesce(F.least(left, F.length(text) - SNIPPET), F.lit(0)).cast("int")
    cut = F.concat(F.when(left > 0, "...").otherwise(""), F.substring(text, left + 1, F.lit(SNIPPET)), F.when(left + SNIPPET < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= SNIPPET, text).otherwise(cut)


def highlights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, start, end of the words of `text` that are content words of `question` of three letters or more, in any case."""
    terms = F.filter(F.array_distinct(content_tokens(F.col("question"))), lambda t: F.length(t) >= TERM)
    words = F.transform("pieces", lambda p: F.lower(F.regexp_replace(p, r"(?U)^\W+", "")))
    cut = rows.select(*keys, terms.alias("terms"), F.regexp_extract_all("text", F.lit(r"(?U)\W*\w+"), F.lit(0)).alias("pieces")).withColumn("words", words)
    # a long question's terms don't go along with every piece: of the terms only those of this text are looked for, and a piece keeps its word if it is one
    cut = cut.select(*keys, "pieces", "words", F.array_intersect("terms", "words").alias("met"))
    each = F.zip_with("pieces", "words", lambda p, w: F.struct(F.length(p).alias("size"), F.when(F.array_contains("met", w), w).alias("term")))
    cut = cut.select(*keys, F.posexplode(each).alias("piece_no", "piece")).select(*keys, "piece_no", "piece.*")
    end = F.sum("size").over(Window.partitionBy(*keys).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0))
    found = cut.withColumn("end", end).where("term IS NOT NULL")
    return found.select(*keys, "term", (F.col("end") - F.length("term")).alias("start"), "end")


def carries_words(piece: Column) -> Column:
    return F.regexp_replace(piece, r"\[\d+\]", "").rlike(r"[\p{L}\p{N}]")


def claims(answer: Column) -> Column:
    """Sentences of an answer, quotations whole; a piece without words goes to the claim before it."""
    pieces = F.regexp_extract_all(answer, F.lit(CLAIM), F.lit(0))
    joined = lambda done, p: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), p)))
    return F.aggregate(pieces, F.array().cast("array<string>"), lambda done, p: F.when(carries_words(p) | (F.size(done) == 0), F.concat(done, F.array(p))).otherwise(joined(done, p)))


def judged_claims(answer: Column, contexts: Column) -> Column:
    """claim and the reason for which it is dropped (null: it stays) of each claim; one without words stays if it has no marker."""
    reason = lambda c: F.when(carries_words(c), contract_violation(c, contexts)).when(c.rlike(r"\[\d+\]"), "no_claim")
    return F.transform(claims(answer), lambda c: F.struct(c.alias("claim"), reason(c).alias("reason")))


def drop_unsupported(answers: DataFrame) -> DataFrame:
    """answers with `kept` (what is left of the answer) and `dropped` (claim and reason of what isn't)."""
    rows = answers.withColumn("judged", judged_claims(F.col("answer"), F.col("contexts")))
    kept = stripped(F.array_join(F.transform(F.filter("judged", lambda j: j["reason"].isNull()), lambda j: j["claim"]), ""))
    dropped = F.transform(F.filter("judged", lambda j: j["reason"].isNotNull()), lambda j: F.struct(stripped(j["claim"]).alias("claim"), j["reason"].alias("reason")))
    return rows.select("*", kept.alias("kept"), dropped.alias("dropped")).drop("judged")


def judged_sentences(answer: Column) -> Column:
    return F.split(answer, JUDGED)


def _share(words: Column, support: Column) -> Column:
    return F.size(F.array_intersect(words, support)) / F.size(words)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once; within a lambda it would be computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def faithfulness(answer: Column, contexts: Column) -> Column:
    """The share of sentences half of whose words some context has; null for refusals, without contexts and without words."""
    support = F.flatten(F.transform(contexts, eval_words))
    worded = F.filter(F.transform(judged_sentences(answer), eval_words), lambda w: F.size(w) > 0)
    both = _once(worded, lambda ws: F.struct(ws.alias("worded"), F.array_intersect(F.flatten(ws), support).alias("met")))
    share = _once(both, lambda b: F.when(F.size(b["worded"]) > 0, F.size(F.filter(b["worded"], lambda w: _share(w, b["met"]) >= SUPPORT)) / F.size(b["worded"])))
    return F.when((F.size(contexts) > 0) & ~is_refusal(answer), share)


def unsupported(answer: Column, contexts: Column) -> Column:
    """Sentences with markers of which the cited contexts have less than half of the words."""
    cited = lambda s: F.filter(F.transform(markers(s), lambda m: m.cast("int")), lambda m: (m >= 1) & (m <= F.size(contexts)))
    support = lambda s: F.flatten(F.transform(cited(s), lambda m: eval_words(F.element_at(contexts, m))))
    return F.filter(judged_sentences(answer), lambda s: (F.size(markers(s)) > 0) & (F.size(eval_words(s)) > 0) & (_share(eval_words(s), support(s)) < SUPPORT))


def normal(text: Column) -> Column:
    """Squeezed, lower case, without commas within numbers."""
    return F.regexp_replace(flat(text), r"(?<=\d),(?=\d)", "")


def checkable(segment: Column) -> Column:
    """Quotes (with a leading quotation mark), codes, and numbers with the word after them, as they are looked for; years aren't."""
    quotes = F.filter(F.regexp_extract_all(segment, F.lit('"([^"]+)"'), F.lit(1)), lambda q: (F.length(q) >= 8) | q.rlike("[0-9]"))
    outside = F.regexp_replace(segment, '"[^"]+"', " ")
    codes = F.transform(F.regexp_extract_all(outside, F.lit(r"\b[A-Z]{2,}-\d+\b"), F.lit(0)), F.lower)
    numbers = F.regexp_extract_all(outside, F.lit(r"(?<![\w.,-])\d[\d,]*(?:\.\d+)?(?:\s+[A-Za-z]+)?"), F.lit(0))
    numbers = F.filter(F.transform(numbers, lambda n: F.lower(F.regexp_replace(F.regexp_replace(n, ",", ""), r"\s+", " "))), lambda n: ~n.rlike(r"^(19|20)\d\d( |$)"))
    return F.array_distinct(F.concat(F.transform(quotes, lambda q: F.concat(F.lit('"'), normal(q))), codes, numbers))


def holds(text: Column, phrase: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<![\d.,])\Q"), phrase, F.lit(r"\E(?!\d)"))
    return F.when(F.startswith(phrase, F.lit('"')), F.contains(text, F.substring(phrase, F.lit(2), F.length(phrase)))).otherwise(F.regexp_like(text, pattern))


def cited_groups(claim: Column, n: Column) -> Column:
    """cited, segment and the first and last run (from 0) of each run of markers of a claim: the words before it, or after it where those point ahead; all
    words, and all markers as one, where a claim begins with markers. Runs with a marker out of range are left out."""
    numbers = lambda run: F.transform(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), lambda m: m.cast("int"))
    valid = lambda g: F.forall(g["cited"], lambda m: (m >= 1) & (m <= n))
    parts = F.split(claim, MARKER_RUN)
    points = lambda t: F.lower(stripped(t)).rlike("(?:" + "|".join(POINTERS) + ")$")
    segment = lambda i: F.when(points(F.get(parts, i)), F.get(parts, i + 1)).otherwise(F.get(parts, i))
    runs = F.transform(F.regexp_extract_all(claim, F.lit(MARKER_RUN), F.lit(0)), lambda r, i: F.struct(numbers(r).alias("cited"), segment(i).alias("segment"), i.alias("first"), i.alias("last")))
    runs = F.filter(runs, valid)
    whole = F.struct(F.array_distinct(F.flatten(F.transform(runs, lambda g: g["cited"]))).alias("cited"), F.array_join(parts, " ").alias("segment"), F.array_min(runs["first"]).alias("first"), F.array_max(runs["last"]).alias("last"))
    return F.when((F.size(runs) > 0) & (stripped(F.get(parts, F.lit(0))) == ""), F.array(whole)).otherwise(runs)


def misattributions(answer: Column, contexts: Column) -> Column:
    """phrase, cited, holders of each number, code or quote that no passage cited for it has but another one does."""
    texts = F.transform(contexts, normal)
    cited_text = lambda g: F.array_join(F.transform(g["cited"], lambda m: F.element_at(texts, m)), " ")
    holders = lambda g, p: F.filter(F.transform(texts, lambda t, i: F.when(holds(t, p), i + 1)), lambda k: k.isNotNull() & ~F.array_contains(g["cited"], k))
    flagged = lambda g: F.filter(
        F.transform(F.filter(checkable(g["segment"]), lambda p: ~holds(cited_text(g), p)), lambda p: F.struct(F.ltrim(p, F.lit('"')).alias("phrase"), g["cited"].alias("cited"), holders(g, p).alias("holders"))),
        lambda m: F.size(m["holders"]) > 0,
    )
    groups = F.flatten(F.transform(claims(answer), lambda c: cited_groups(c, F.size(contexts))))
    return F.flatten(F.transform(groups, flagged))


def long_words(text: Column) -> Column:
    """Distinct words of four letters or digits and more of a text as of `normal`."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]{4,}"), F.lit(0)))


def _repaired_claim(claim: Column, texts: Column, words: Column) -> Column:
    """text, repairs and unresolved of one claim; texts (as of `normal`) and words (of each) of the contexts."""
    shared = lambda k, own: F.size(F.array_intersect(own, F.element_at(words, k)))

    def judged(g: Column) -> Column:
        own, phrases = long_words(normal(g["segment"])), checkable(g["segment"])
        cited_text = F.array_join(F.transform(g["cited"], lambda m: F.element_at(texts, m)), " ")
        others = lambda p: F.filter(F.transform(texts, lambda t, i: F.when(holds(t, p), i + 1)), lambda k: k.isNotNull() & ~F.array_contains(g["cited"], k))
        best = lambda ks: F.array_sort(F.transform(ks, lambda k: F.struct((-shared(k, own)).alias("n"), k.alias("k"))))
        pick = lambda ks: F.when(F.size(ks) == 1, F.get(ks, F.lit(0))).when(F.get(best(ks), F.lit(0))["n"] < F.get(best(ks), F.lit(1))["n"], F.get(best(ks), F.lit(0))["k"])
        flagged = F.filter(F.transform(F.filter(phrases, lambda p: ~holds(cited_text, p)), lambda p: F.struct(F.ltrim(p, F.lit('"')).alias("phrase"), others(p).alias("holders"))), lambda m: F.size(m["holders"]) > 0)
        flagged = F.transform(flagged, lambda m: F.struct(m["phrase"].alias("phrase"), m["holders"].alias("holders"), pick(m["holders"]).alias("pick")))
        stays = lambda n: F.exists(phrases, lambda p: holds(F.element_at(texts, n), p)) | (F.size(own) == 0) | (shared(n, own) / F.size(own) >= KEEPING)
        return F.struct(g["cited"].alias("cited"), g["first"].alias("first"), g["last"].alias("last"), flagged.alias("flagged"), F.filter(g["cited"], stays).alias("kept"))

    def settled(g: Column) -> Column:
        picks = F.filter(F.transform(g["flagged"], lambda m: m["pick"]), lambda k: k.isNotNull())
        return F.struct(g["cited"].alias("cited"), g["first"].alias("first"), g["last"].alias("last"), g["flagged"].alias("flagged"), F.when(F.size(picks) > 0, F.array_sort(F.array_distinct(F.concat(g["kept"], picks)))).alias("final"))

    return F.transform(F.transform(cited_groups(claim, F.size(texts)), judged), settled)


def repaired(answers: DataFrame) -> DataFrame:
    """answers with `repaired`, the answer with misplaced markers moved, and repairs (phrase, cited, moved_to) and unresolved (phrase, cited, holders).

    A number, code or quote that no passage cited for it has, but another one does, takes a marker of that passage: of several the one that shares most longer words with the claim;
    with a tie nothing is moved and it is unresolved. A cited passage keeps its marker if it has another such phrase of the claim or a third of its longer
    words. Nothing else of the answer changes.
    """
    rows = answers.withColumn("__texts", F.transform("contexts", normal))
    rows = rows.withColumn("__claims", claims(F.coalesce("answer", F.lit("")))).withColumn("__words", F.transform("__texts", long_words))
    rows = rows.withColumn("__groups", F.transform("__claims", lambda c: _repaired_claim(c, F.col("__texts"), F.col("__words"))))

    def written(claim: Column, groups: Column) -> Column:
        parts, runs = F.split(claim, MARKER_RUN), F.regexp_extract_all(claim, F.lit(MARKER_RUN), F.lit(0))
        edits = F.filter(groups, lambda g: g["final"].isNotNull())
        of = lambda i: F.get(F.filter(edits, lambda g: (g["first"] <= i) & (i <= g["last"])), F.lit(0))
        new = lambda i: F.when(of(i)["first"] == i, F.array_join(F.transform(of(i)["final"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")).otherwise("")
        run = lambda i: F.when(of(i).isNull(), F.coalesce(F.get(runs, i), F.lit(""))).otherwise(new(i))
        part = lambda x, i: F.when(F.exists(edits, lambda g: (g["first"] < i) & (i <= g["last"])), "").otherwise(x)
        return F.array_join(F.transform(parts, lambda x, i: F.concat(part(x, i), run(i))), "")

    groups = F.filter(F.flatten("__groups"), lambda g: F.size(g["flagged"]) > 0)
    moved = F.flatten(F.transform(groups, lambda g: F.transform(F.array_distinct(F.transform(F.filter(g["flagged"], lambda m: m["pick"].isNotNull()), lambda m: m["phrase"])), lambda p: F.struct(p.alias("phrase"), g["cited"].alias("cited"), g["final"].alias("moved_to")))))
    left = F.flatten(F.transform(groups, lambda g: F.transform(F.filter(g["flagged"], lambda m: m["pick"].isNull()), lambda m: F.struct(m["phrase"].alias("phrase"), g["cited"].alias("cited"), m["holders"].alias("holders")))))
    rows = rows.withColumn("repairs", moved).withColumn("unresolved", left)
    text = F.array_join(F.zip_with("__claims", "__groups", written), "")
    return rows.withColumn("repaired", F.when(F.size("repairs") > 0, text).otherwise(F.col("answer"))).drop("__texts", "__claims", "__words", "__groups")


def citation_check(answers: DataFrame) -> DataFrame:
    """answers with `correct` and `reason`: the contract, support of each cited sentence, and no misplaced number, code or quote.

    Null for an empty answer. A refusal is right only without passages.
    """
    answer, contexts = F.col("answer"), F.col("contexts")
    some = F.size(contexts) > 0
    reason = (
        F.when(F.coalesce(stripped(answer), F.lit("")) == "", "empty")
        .when((F.size(markers(answer)) == 0) & is_refusal(answer), F.when(some, "refused_with_passages"))
        .otherwise(
            F.coalesce(
                contract_violation(answer, contexts), F.when(F.size(markers(answer)) == 0, "uncited"), F.when(F.size(unsupported(answer, contexts)) > 0, "unsupported"), F.when(F.size(misattributions(answer, contexts)) > 0, "misattributed"),
            )
        )
    )
    rows = answers.withColumn("reason", reason)
    return rows.withColumn("correct", F.when(F.col("reason") == "empty", F.lit(None)).otherwise(F.col("reason").isNull()))
