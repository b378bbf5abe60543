"""Queries over texts: cleaning, headings, chunks, tokens, hashes, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.records import expanded
from siftwell.plans.registry import query, table
from siftwell.sources.parsers import csv_line, sniffed

_STOP = "[" + ", ".join(f"'{w}'" for w in T.EMBED_STOPWORDS) + "]"
_EVAL_STOP = "[" + ", ".join(f"'{w}'" for w in T.EVAL_STOPWORDS) + ", '']"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_CONTENT = f"CASE WHEN len(list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t))) = 0 THEN {_TOKENS} ELSE list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t)) END"


@query(
    "txt01_clean_pages",
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM b)
    SELECT doc_id, length(t) AS n_chars_clean, md5(t) AS digest FROM c""",
)
def clean_pages(spark, sf_dir):
    clean = T.clean_page(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_chars_clean"), F.md5(clean).alias("digest"))


@query(
    "txt02_repeated_lines",
    """WITH l AS (SELECT doc_id, trim(u.line) AS line, (u.i - 1) // 20 AS page FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
    r AS (SELECT doc_id, line FROM l WHERE line <> '' GROUP BY doc_id, line HAVING count(DISTINCT page) >= 3)
    SELECT l.doc_id, count(*) AS lines_removed FROM l JOIN r USING (doc_id, line) GROUP BY l.doc_id""",
)
def repeated_lines(spark, sf_dir):
    """Pages of twenty lines; a line on three pages or more is a header or footer. Grouped by document and line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("doc_id", F.trim("line").alias("line"), F.floor(F.col("i") / 20).alias("page")).where("line <> ''")
    found = lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n")).where("pages >= 3")
    return found.groupBy("doc_id").agg(F.sum("n").alias("lines_removed"))


_STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_TITLE = rf"""CASE WHEN {_STRIPPED} = '' OR length({_STRIPPED}) > 80 THEN NULL WHEN regexp_matches({_STRIPPED}, '^#{{1,6}}\s+.') THEN regexp_replace({_STRIPPED}, '^#{{1,6}}\s+', '') WHEN regexp_matches({_STRIPPED}, '^[0-9]+(\.[0-9]+)*[.)]?\s+[^\s]') THEN {_STRIPPED}
  WHEN NOT regexp_matches({_STRIPPED}, '[.,;:]$') AND len(regexp_extract_all({_STRIPPED}, '\pL')) >= 3 AND len(regexp_extract_all({_STRIPPED}, '\pL')) = len(regexp_extract_all({_STRIPPED}, '\p{{Lu}}')) THEN {_STRIPPED} END"""


@query(
    "txt04_headings",
    r"""WITH l AS (SELECT doc_id, u.line, u.i FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
    o AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start_offset FROM l)
    SELECT doc_id, i AS line_no, CAST(start_offset AS BIGINT) AS start_offset, """
    + _TITLE
    + """ AS title FROM o WHERE title IS NOT NULL""",
)
def headings(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("line") - 1
    rows = lines.withColumns({"start_offset": before.cast("long"), "title": T.heading(F.col("line"))}).where("title IS NOT NULL")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "start_offset", "title")


@query(
    "txt05_document_type",
    """WITH e AS (SELECT regexp_extract(url, '\\.([a-z]{2,5})([?#]|$)', 1) AS ext FROM pages)
    SELECT CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'word' WHEN 'pptx' THEN 'slides' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'table' WHEN 'md' THEN 'markdown' ELSE 'other' END AS document_type, count(*) AS n
    FROM e GROUP BY 1""".replace("\\\\", "\\"),
)
def document_types(spark, sf_dir):
    ext = F.regexp_extract("url", r"\.([a-z]{2,5})([?#]|$)", 1)
    kind = F.create_map(*[F.lit(x) for pair in T.DOCUMENT_TYPES.items() for x in pair])[ext]
    return table(spark, sf_dir, "pages").groupBy(F.coalesce(kind, F.lit("other")).alias("document_type")).agg(F.count("*").alias("n"))


_CHUNKS = r"""WITH p AS (SELECT doc_id, u.body, u.page FROM documents, unnest(string_split(coalesce(text, ''), chr(12))) WITH ORDINALITY AS u(body, page)),
    w AS (SELECT doc_id, page, k, substr(body, k * 520 + 1, 600) AS piece
      FROM p, unnest(range(0, CASE WHEN length(body) <= 600 THEN 1 ELSE 1 + CAST(ceil((length(body) - 600) / 520.0) AS BIGINT) END)) AS r(k)),
    s AS (SELECT doc_id, page, k, piece, regexp_replace(piece, '^\s+', '') AS l FROM w),
    c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS chunk_index, page, k * 520 + length(piece) - length(l) AS char_start, regexp_replace(l, '\s+$', '') AS body
      FROM s WHERE regexp_replace(l, '\s+$', '') <> '')"""


@query("txt06_chunks", _CHUNKS + " SELECT doc_id, chunk_index, page, char_start, char_start + length(body) AS char_end, md5(body) AS digest FROM c")
def chunks(spark, sf_dir):
    return T.chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "page", "char_start", "char_end", F.md5("text").alias("digest"))


@query("txt06_chunk_stats", _CHUNKS + " SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return T.chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@query(
    "jn12_expanded",
    _CHUNKS
    + """, rx AS (SELECT doc_id, chunk_index, char_start, char_start + length(body) AS char_end FROM c), sx AS (SELECT h.doc_id, h.chunk_index, min(n.char_start) AS a, max(n.char_end) AS e FROM rx h JOIN rx n ON h.doc_id = n.doc_id AND n.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2 WHERE h.doc_id % 20 = 0 GROUP BY 1, 2)
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(a AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", md5(substr(text, a + 1, e - a)) AS digest FROM sx JOIN documents USING (doc_id)""",
)
def expanded_hits(spark, sf_dir):
    """Chunks of the documents whose id is divisible by 20, with two chunks on either side."""
    docs = table(spark, sf_dir, "documents")
    chunks = T.chunks(docs).select("doc_id", "chunk_index", "char_start", "char_end")
    found = expanded(chunks.where("doc_id % 20 = 0"), chunks, docs, 2)
    return found.select("doc_id", "chunk_index", "start", "end", F.md5("text").alias("digest"))


@query(
    "jn12_neighbours",
    _CHUNKS
    + """, n AS (SELECT doc_id, chunk_index, char_start, char_end, lag(char_end) OVER w AS before_end, lag(char_start) OVER w AS before_start, lead(char_start) OVER w AS after_start, lead(char_end) OVER w AS after_end
      FROM (SELECT *, char_start + length(body) AS char_end FROM c) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
    SELECT doc_id, chunk_index, CASE WHEN before_end IS NULL THEN -1 ELSE least(before_end, char_start) - before_start END AS before_len, CASE WHEN after_end IS NULL THEN -1 ELSE after_end - greatest(after_start, char_end) END AS after_len FROM n""",
)
def neighbours(spark, sf_dir):
    """Lengths of the chunks before and after each, without what they share with it; -1 for none."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = T.chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "char_start", "char_end")
    before = F.when(F.lag("char_end").over(w).isNotNull(), F.least(F.lag("char_end").over(w), "char_start") - F.lag("char_start").over(w)).otherwise(-1)
    after = F.when(F.lead("char_end").over(w).isNotNull(), F.lead("char_end").over(w) - F.greatest(F.lead("char_start").over(w), "char_end")).otherwise(-1)
    return rows.select("doc_id", "chunk_index", before.alias("before_len"), after.alias("after_len"))


@query("txt07_tokens", f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("txt08_content_tokens", f"SELECT doc_id, len({_CONTENT}) AS n_tokens, md5(array_to_string({_CONTENT}, ' ')) AS digest FROM documents")
def content_token_counts(spark, sf_dir):
    t = T.content_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(
    "txt09_eval_words",
    rf"""SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\[[0-9]+\]', ' ', 'g'), '[a-z0-9][a-z0-9\-.,]*[a-z0-9]|[a-z0-9]')), lambda w: NOT list_contains({_EVAL_STOP}, w))) AS n_words
    FROM conversations""",
)
def eval_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.eval_words(F.col("text"))).cast("long").alias("n_words"))


@query(
    "txt10_hash_embedding",
    f"""WITH t AS (SELECT doc_id, unnest({_CONTENT}) AS t FROM documents),
    h AS (SELECT doc_id, CAST(CAST(concat('0x', substr(md5(t),15,2), substr(md5(t),13,2), substr(md5(t),11,2), substr(md5(t),9,2), substr(md5(t),7,2), substr(md5(t),5,2), substr(md5(t),3,2), substr(md5(t),1,2)) AS UBIGINT) % 64 AS BIGINT) AS bucket FROM t),
    c AS (SELECT doc_id, bucket, count(*) AS c FROM h GROUP BY doc_id, bucket)
    SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
)
def hash_embedding(spark, sf_dir):
    return T.hashed_weights(table(spark, sf_dir, "documents")).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("txt12_token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("txt17_duplicate_hashes", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


@query("txt16_slugs", "SELECT DISTINCT c_mktsegment AS name, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark, sf_dir):
    name = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(name.alias("name"), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug")).distinct()


@query(
    "src03_csv_flatten",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, concat_ws('; ', 'nation: ' || n_name, 'region: ' || r_name) AS line FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def csv_flatten(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), csv_line({"nation": F.col("n_name"), "region": F.col("r_name")}).alias("line"))


@query(
    "src07_text_sniff",
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN 'rejected' WHEN strlen(text) > 20000 THEN 'rejected' WHEN starts_with(text, '%PDF-') THEN 'rejected' ELSE 'accepted' END AS status,
    CASE WHEN length(text) = 0 THEN 'empty' WHEN strlen(text) > 20000 THEN 'too_large' WHEN starts_with(text, '%PDF-') THEN 'binary' END AS reason FROM documents""",
)
def text_sniff(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in sniffed(F.encode("text", "UTF-8"), 20000).items()])


@query("src12_duplicate_questions", "SELECT text AS question, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY text HAVING count(*) > 1")
def duplicate_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("text").alias("question")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    "src13_qrels_import",
    """SELECT 'kept' AS what, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality > 0
    UNION ALL SELECT 'score', count(*) FROM labels WHERE quality <= 0
    UNION ALL SELECT 'document', count(*) FROM labels WHERE quality > 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)""",
)
def qrels(spark, sf_dir):
    """Judgements kept, and dropped for their score or a missing document."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("known"))
    rows = labels.join(docs, "doc_id", "left").select(F.when(F.col("quality") <= 0, "score").when(F.col("known"), "kept").otherwise("document").alias("what"))
    kinds = spark.createDataFrame([("kept",), ("score",), ("document",)], "what string")
    return F.broadcast(kinds).join(rows.groupBy("what").agg(F.count("*").alias("n")), "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "src19_answer_import_errors",
    """WITH a AS (SELECT conv_id AS id, text AS answer FROM conversations WHERE role = 'assistant'), asked AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE role = 'user' AND conv_id % 3 > 0),
    n AS (SELECT id, answer, count(*) OVER (PARTITION BY id) AS k FROM a)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n.id NOT IN (SELECT id FROM asked) THEN 'unknown_id' WHEN k > 1 THEN 'duplicate_id' ELSE 'ok' END AS kind FROM n
    UNION ALL SELECT 'missing_answer' FROM asked WHERE id NOT IN (SELECT id FROM a)) GROUP BY kind""",
)
def answer_errors(spark, sf_dir):
    """Answers to a set of questions (two of three conversations): unknown ids, ids answered twice (all copies void), missing."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user' AND conv_id % 3 > 0").select(F.col("conv_id").alias("id")).distinct()
    answers = rows.where("role = 'assistant'").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("k"))
    both = asked.withColumn("asked", F.lit(True)).join(answers, "id", "full_outer")
    kind = F.when(F.col("asked").isNull(), "unknown_id").when(F.col("k").isNull(), "missing_answer").when(F.col("k") > 1, "duplicate_id").otherwise("ok")
    return both.groupBy(kind.alias("kind")).agg(F.sum(F.coalesce("k", F.lit(1))).alias("n"))


@query(
    "sy01_connector_diff",
    """WITH now AS (SELECT doc_id, md5(text) AS h FROM documents WHERE source <> 'src1'), was AS (SELECT doc_id, CASE WHEN lang = 'de' THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE source <> 'src2')
    SELECT CASE WHEN was.doc_id IS NULL THEN 'added' WHEN now.doc_id IS NULL THEN 'deleted' WHEN now.h = was.h THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n
    FROM now FULL OUTER JOIN was ON now.doc_id = was.doc_id GROUP BY 1""",
)
def connector_diff(spark, sf_dir):
    """Two listings of the corpus, told apart by content hash."""
    from siftwell.sources.sync import compare

    docs = table(spark, sf_dir, "documents")
    now = docs.where("source <> 'src1'").select(F.col("doc_id").alias("source_id"), F.md5("text").alias("content_hash"))
    was = docs.where("source <> 'src2'").select(F.col("doc_id").alias("source_id"), F.md5(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return compare(now, was).groupBy("status").agg(F.count("*").alias("n"))
