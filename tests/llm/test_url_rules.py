import re

from siftwell.llm import url_rules as U


def brute(url):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host = low(host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in U.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        *_, rule, verdict = max(fits)
        return host, path, rule, verdict
    hit = {a for a, p, _ in U.PATTERN_RULES if re.search(p, low(u))}
    return host, path, None, "allow" if "allow" in hit or not hit else "block"


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/en/", "http://xcom/en/1", "http://a.b.com/en/9", "https://Example.com/en/71", "http://evil-example.com/en/7",
    "http://www.example.net/de/8?x", "http://www.example.net/de/9", "http://example.org/es/", "http://example.org/ES/", "http://org?/es/", "http://h.org#/es/",
    "http://a.fr/x?utm_source=feed", "http://a.fr/x?utm_other=1", "http://a.fr/?ref=x&y", "http://a.fr/?a=1&sid=3", "http://a.fr/login", "http://a.fr/loginx", "http://a.fr/wp-admin/x",
    "http://a.fr/print/12.html", "http://blog.q.example.com/fr/12.html", "http://blog.q.example.com/fr/12", "ftp://a://b/c", "http://net/de/", "http://.net/de/", "http://a..net/de/é", "http://a.fr/" + "p/" * 5000,
]


def test_edges(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    d = spark.createDataFrame([(i, u, "x", "y") for i, u in [*rows, *rows[:9], (None, URLS[8])]], "page_id long, url string, host string, row string")
    got = sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(d, *U.rule_tables(spark)).collect())
    assert got == sorted([*((i, *brute(u)) for i, u in [*rows, *rows[:9]]), (-1, *brute(URLS[8]))])


def test_empty(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(d, *U.rule_tables(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    hosts, patterns = U.rule_tables(spark)
    assert U.filter_urls(one, hosts.limit(0), patterns.limit(0)).collect()[0].verdict == "allow"


def test_rules_are_filed_under_their_rarest_literal(spark):
    urls = spark.createDataFrame([("http://blog.example.com/x",)] * 3 + [("http://example.com/fr/",)], "url string")
    _, patterns = U.rule_tables(spark)
    filed = {}
    for r in U.index_patterns(urls, patterns).collect():
        filed.setdefault(r.pattern, set()).add(r.token)
    assert filed[U.PATTERN_RULES[5][1]] == {"fr"}
    assert filed[U.PATTERN_RULES[2][1]] == {"sid", "phpsessid", "jsessionid"} and filed[U.PATTERN_RULES[0][1]] == {"source", "medium", "campaign"}
    assert "" not in set().union(*filed.values())  # no rule runs on every url


def test_literals_are_whole_tokens_of_every_match(spark):
    """A host whose name only ends in a word of the pattern is met, also where that word would be the rarest."""
    urls = ["http://blog.myexample.com/fr/1", *["http://blog.a.com/fr/x"] * 3]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    hosts, patterns = U.rule_tables(spark)
    got = {r.page_id: r.verdict for r in U.filter_urls(d, hosts.limit(0), patterns).collect()}
    assert got[0] == "block" and got[1] == "allow"
