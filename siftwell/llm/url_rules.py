"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A rule of several alternatives is filed under a literal of each. One exploded key column meets one rule table: the suffixes of a url's host fetch host rules, its tokens fetch the
pattern rules filed under them, and only fetched rules are tried. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule tables of at most this many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 100_000

#: (action, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
HOST_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: (action, pattern over the lower-cased url, its alternatives: of each the literal tokens that all its matches have as whole tokens).
PATTERN_RULES = [
    ("block", r"[?&]utm_(source|medium|campaign)=", [["utm", "source"], ["utm", "medium"], ["utm", "campaign"]]),
    ("block", r"[?&]ref=[^&#]*(&|#|$)", [["ref"]]),
    ("block", r"[?&](sid|phpsessid|jsessionid)=", [["sid"], ["phpsessid"], ["jsessionid"]]),
    ("block", r"/(login|signin|logout)(/|\?|#|$)", [["login"], ["signin"], ["logout"]]),
    ("block", r"/wp-admin/", [["wp", "admin"]]),
    ("block", r"^https?://blog\.[^/]*example\.com/fr/", [["blog", "com", "fr"]]),
    ("block", r"/print/[0-9]+(\.html)?$", [["print"]]),
    ("allow", r"^https?://blog\.[^/]*/fr/[0-9]+\.html$", [["blog", "fr", "html"]]),
]
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows that up
    to `?`, `#` or the end. Both are empty for null urls and without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct maximal runs of a-z and 0-9 of the lower-cased url."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_tables(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> tuple[DataFrame, DataFrame]:
    hosts = spark.createDataFrame([(a, h, p) for a, h, p in host_rules], "action string, host string, path string")
    patterns = spark.createDataFrame([(a, p, t) for a, p, all_of in pattern_rules for t in all_of or [[]]], "action string, pattern string, literals array<string>")
    return hosts, patterns


def index_patterns(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """The pattern rules with the literals under which each is filed: of each alternative the one that fewest rows of `urls` have, the first
    in order among equals, and '' for rules without literals, which all urls fetch."""
    patterns = patterns.withColumn("literals", F.array_sort("literals")).distinct()
    literals = patterns.select(F.explode("literals").alias("token")).distinct()
    counts = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(sized(literals), "token", "left_semi").groupBy("token").count()
    each = patterns.select("action", "pattern", "literals", F.explode_outer("literals").alias("token"))
    ranked = each.join(sized(counts), "token", "left").select("action", "pattern", "literals", F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")).alias("by"))
    return ranked.groupBy("action", "pattern", "literals").agg(F.min("by")["token"].alias("token")).select("action", "pattern", "token").distinct()


def sized(rules: DataFrame) -> DataFrame:
    """A broadcast hint if the table is small."""
    return F.broadcast(rules) if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rules


def filter_urls(pages: DataFrame, host_rules: DataFrame, pattern_rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule (the longest fitting host rule, as host + path) and verdict of each row.

    The host rule's action is the verdict; without one, the fetched pattern rules decide: an allowing match outweighs
    a blocking one, and no match gives `default`. Of host rules of one length the one with the longer host wins, then the
    later in order. Null urls have no host and no tokens and get `default`. Every row of `pages` gives one row, repeated
    ones too; other columns are ignored.
    """
    rows = pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id())
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    keys = F.concat(F.array(F.lit("t:")), suffixes, F.transform(tokens(F.col("url")), lambda t: F.concat(F.lit("t:"), t)))
    filed = host_rules.select(F.concat(F.lit("h:"), "host").alias("key"), "action", F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), F.col("path").alias("own_path"), F.lit(None).cast("string").alias("pattern")).unionByName(
        index_patterns(pages, pattern_rules).select(F.concat(F.lit("t:"), "token").alias("key"), "action", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("host_size"), F.lit(None).cast("string").alias("own_path"), "pattern")
    )
    fetched = rows.select("*", F.explode(keys).alias("key")).join(sized(filed), "key", "left")
    host_fits = F.col("rule").isNotNull() & F.startswith("path", "own_path")
    pattern_fits = F.col("pattern").isNotNull() & F.expr("rlike(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)")
    best = fetched.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "host", "path")],
        F.max(F.when(host_fits, F.struct(F.length("rule").alias("size"), "host_size", "rule", "action"))).alias("host_rule"),
        F.coalesce(F.bool_or(pattern_fits & (F.col("action") == "allow")), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(pattern_fits & (F.col("action") == "block")), F.lit(False)).alias("blocked"),
    )
    by_pattern = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise(default)
    return best.select("page_id", "url", "host", "path", F.col("host_rule.rule").alias("rule"), F.coalesce("host_rule.action", by_pattern).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), *rule_tables(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """DuckDB SQL of op10: every rule is tried on every url."""
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in longest)
    action = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{a}'" for a, h, p in longest)
    some = {a: " OR ".join(f"regexp_matches(low, '{p}')" for x, p, _ in PATTERN_RULES if x == a) for a in ("allow", "block")}
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {action} WHEN {some["allow"]} THEN 'allow' WHEN {some["block"]} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


ORACLE_SQL = _sql()
