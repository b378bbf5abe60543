"""Queries of records: pages and newest rows, latest phases, visibility, sections, cleaned texts, deletion, sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.names import name_key
from siftwell.operators import access as A
from siftwell.operators import records as R
from siftwell.plans.registry import query, table
from siftwell.plans.text import _CHUNKS, _TITLE


@query("tk02_keyset_page", "SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return R.page_after(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100, 50)


@query("tk03_list_documents", "SELECT doc_id, source, lang FROM documents WHERE source = 'src1' AND lang = 'en' ORDER BY n_chars DESC, doc_id DESC")
def list_documents(spark, sf_dir):
    return R.newest(table(spark, sf_dir, "documents").where("source = 'src1' AND lang = 'en'"), "n_chars", "doc_id").select("doc_id", "source", "lang")


@query("tk04_recent_queries", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_queries(spark, sf_dir):
    return R.newest(table(spark, sf_dir, "events"), "ts", "event_id", n=10).select("event_id", "event_type")


@query("ag18_latest_phases", "SELECT user_id AS document_id, max(event_id) FILTER (WHERE event_type = 'click') AS ingest, max(event_id) FILTER (WHERE event_type = 'view') AS index, coalesce(max(event_id) FILTER (WHERE event_type = 'view') > max(event_id) FILTER (WHERE event_type = 'click'), false) AS indexed_since FROM events GROUP BY 1")
def latest_phases(spark, sf_dir):
    phase = F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "view", "index")
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("document_id"), phase.alias("phase"))
    return R.latest_phases(runs, ["ingest", "index"]).withColumn("indexed_since", F.coalesce(F.col("index") > F.col("ingest"), F.lit(False)))


@query("wn_first_of_kind", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_of_kind(spark, sf_dir):
    return R.firsts(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("so01_source_union", "SELECT CAST(l_orderkey AS BIGINT) AS chunk_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT CAST(o_orderkey AS BIGINT) FROM orders WHERE o_orderstatus = 'F'")
def source_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("long").alias("chunk_id"))
    return a.union(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("long"))).distinct()


@query("so03_merge_subgraphs", "SELECT CAST(l_partkey AS BIGINT) AS id, max(CAST(l_linenumber AS BIGINT)) AS part FROM lineitem GROUP BY 1")
def merge_subgraphs(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("part"))
    return R.merged_subgraphs(parts)


@query("so04_key_scope", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2') AND source IN (SELECT source FROM documents WHERE lang = 'de')")
def key_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mine = docs.where(A.allowed(F.col("doc_id"), F.col("source"), None, ["src0", "src1", "src2"])).select("doc_id", "source")
    return R.scoped(mine, docs.where("lang = 'de'").select("source").distinct(), "source").select("doc_id")


@query("flt05_model_pin", "SELECT vec_id FROM embeddings WHERE label = 3")
def model_pin(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id")


@query("flt13_stuck", "SELECT event_id FROM events WHERE event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 300 SECOND")
def stuck(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "indexing").alias("status"), F.col("ts").alias("created_at"))
    now = e.agg(F.max("created_at").alias("now"))  # one row
    return R.stuck(e.join(F.broadcast(now)), F.col("now")).select("event_id")


_ADMITTED = "ad AS (SELECT o_orderkey AS chunk_id FROM orders WHERE (o_custkey IN (1, 2, 3) OR o_orderpriority IN ('1-URGENT', '5-LOW')) AND o_custkey NOT IN (2, 12)), vn AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN ad ON l_orderkey = chunk_id WHERE l_quantity < 5)"


def _visible_parts(spark, sf_dir):
    """Parts as entities, small lines as their sources, orders as chunks of customers (documents) and priorities (collections)."""
    orders = table(spark, sf_dir, "orders").where(A.allowed(F.col("o_custkey"), F.col("o_orderpriority"), [1, 2, 3], ["1-URGENT", "5-LOW"], [2, 12]))
    admitted = orders.select(F.col("o_orderkey").alias("chunk_id"))
    sources = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("chunk_id"))
    return R.visible(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), sources, admitted), admitted


@query("jn04_visible_entities", f"WITH {_ADMITTED} SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey IN (SELECT id FROM vn)")
def visible_entities(spark, sf_dir):
    return _visible_parts(spark, sf_dir)[0].select(F.col("id").cast("long").alias("id"))


@query("jn04_visible_edges", f"WITH {_ADMITTED} SELECT DISTINCT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst FROM lineitem JOIN ad ON l_orderkey = chunk_id WHERE l_partkey IN (SELECT id FROM vn)")
def visible_edges(spark, sf_dir):
    """Edges from parts to suppliers that an admitted line tells of and whose part can be seen."""
    nodes, admitted = _visible_parts(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("chunk_id"))
    edges = R.visible(lines.select("id").distinct(), lines, admitted).select(F.col("id.l_partkey").alias("id"), F.col("id.l_suppkey").alias("dst"))
    return edges.join(nodes, "id", "left_semi").select(F.col("id").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(
    "jn11_sections",
    _CHUNKS
    + r""", l AS (SELECT doc_id, u.line, u.i FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
    o AS (SELECT doc_id, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start FROM l),
    h AS (SELECT doc_id, start, """
    + _TITLE
    + """ AS title FROM o WHERE title IS NOT NULL)
    SELECT c.doc_id, c.chunk_index, h.title AS section FROM c ASOF LEFT JOIN h ON c.doc_id = h.doc_id AND c.char_start >= h.start""",
)
def sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = F.sum(F.length("line") + 1).over(R.Window.partitionBy("doc_id").orderBy("i")) - F.length("line") - 1
    found = lines.withColumn("start", before.cast("long")).select("doc_id", "start", T.heading(F.col("line")).alias("title")).where("title IS NOT NULL")
    points = T.chunks(docs).select("doc_id", F.col("char_start").alias("start"), "chunk_index")
    return R.headings_in_force(points, found, ["doc_id"]).select("doc_id", "chunk_index", "section")


@query(
    "txt03_clean_texts",
    r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i = 1 THEN '' WHEN i % 20 = 1 THEN chr(12) ELSE chr(10) END || l), '') AS text FROM documents),
    p AS (SELECT doc_id, u.b, u.i AS page FROM t, unnest(string_split(text, chr(12))) WITH ORDINALITY AS u(b, i)),
    a AS (SELECT doc_id, page, regexp_replace(b, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS b FROM p),
    c AS (SELECT doc_id, page, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS b FROM a),
    l AS (SELECT doc_id, page, u.line, u.i FROM c, unnest(string_split(b, chr(10))) WITH ORDINALITY AS u(line, i)),
    r AS (SELECT doc_id, line FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3),
    k AS (SELECT doc_id, page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE (doc_id, line) NOT IN (SELECT (doc_id, line) FROM r)), '') AS b FROM l GROUP BY 1, 2)
    SELECT doc_id, md5(string_agg(b, chr(12) ORDER BY page)) AS digest FROM k GROUP BY 1""",
)
def clean_texts(spark, sf_dir):
    """Texts in pages of twenty lines, cleaned, without lines that stand on three pages or more."""
    paged = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.when(i == 0, "").when(i % 20 == 0, "\f").otherwise("\n"), l)), "")
    return table(spark, sf_dir, "documents").select("doc_id", paged.alias("text")).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query(
    "txt18_fingerprint",
    "SELECT item_id AS group_id, substr(sha256(string_agg(lpad(CAST(u.i AS VARCHAR), 9, '0') || u.line, '' ORDER BY u.i)), 1, 12) AS fingerprint FROM benchmark, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i) GROUP BY 1",
)
def fingerprints(spark, sf_dir):
    """Of the lines of each passage as files."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("group_id"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return R.fingerprint(lines.select("group_id", F.lpad((F.col("i") + 1).cast("string"), 9, "0").alias("name"), "content"))


@query(
    "del_everywhere",
    "SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 3) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 3)",
)
def delete_everywhere(spark, sf_dir):
    """What is left in each table when documents are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    tables = {"documents": docs, "labels": table(spark, sf_dir, "labels").select("doc_id"), "embeddings": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))}
    left = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in R.without_documents(tables, docs.where("doc_id % 7 = 3")).items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@query(
    "st_sliding_windows",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) - u.k * 86400 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, unnest([0, 1, 2]) AS u(k) GROUP BY 1, 2",
)
def sliding_windows(spark, sf_dir):
    """Three days each, one every day."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query(
    "gr15_coverage",
    f"WITH {_ADMITTED} SELECT count(*) > 0 AS covered FROM vn",
)
def coverage(spark, sf_dir):
    """Whether any entity can be seen."""
    return _visible_parts(spark, sf_dir)[0].limit(1).agg((F.count("*") > 0).alias("covered"))


@query("txt15_names", r"""SELECT CAST(p_partkey AS BIGINT) AS id, lower(p_name) AS key FROM part""")
def names(spark, sf_dir):
    """Names in quotes, brackets and full width come to the same key."""
    n = F.col("p_name")
    odd = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  «("), F.upper(n), F.lit(")». "))).when(F.col("p_partkey") % 3 == 1, F.translate(n, "abcdefghij", "ａｂｃｄｅｆｇｈｉｊ")).otherwise(F.concat(F.lit("“"), n, F.lit("”!?")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), name_key(odd).alias("key"))
