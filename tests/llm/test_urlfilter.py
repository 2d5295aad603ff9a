"""URL rules against a judge that tries every rule."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import urlfilter


def brute(url, hosts, patterns):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in hosts:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    hit = any(re.search(".*".join(map(re.escape, p.split("*"))), low, re.S) for p in patterns)
    return host, path, None, "block" if hit else "allow"


def test_matches_trying_every_rule(spark):
    rng = random.Random(8)
    bits = ["example", ".net", ".com", ".org", "net", "org", "/en/", "/de/", "/fr/", "://", "http", "?", "#", "www.", "X", "É", "/wp-admin/", "/WP-LOGIN.php", "?sessionid=", "//ads.", "//tracking.a/pixel", ":80", "\n", "%", "_"]
    urls = ["".join(rng.choices(bits, k=rng.randrange(0, 9))) for _ in range(1500)]
    urls += [None, "", "http://net/", "http://net", "http://NET/a", "x://example.net/en/", "x://a.example.net/en", "x://badexample.net/en/", "http://a.org/fr/", "http://a.org/FR/", "http://b.example.com/de/1", "http://" + "a" * 50_000 + ".net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "token": F.lit("x")})
    got = {r.page_id: tuple(r)[1:5] for r in urlfilter.judge_urls(df).collect()}
    assert got == {i: brute(u, urlfilter.HOST_RULES, urlfilter.PATTERNS) for i, u in enumerate(urls)}
    assert {v[2] for v in got.values()} == {None, *(r for _, r in urlfilter.HOST_RULES)} and {v[3] for v in got.values()} == {"allow", "block"}


def test_only_rules_under_a_token_of_the_url_run():
    rules = [urlfilter.host_rule(*r) for r in urlfilter.HOST_RULES]
    index = urlfilter.Index(rules, {"net": 100, "example": 100, "en": 5, "com": 2, "de": 9, "org": 9, "fr": 3})
    assert [r.text for r in index.candidates("http://a.example.net/de/")] == ["net/"]
    assert set(index.by_token) == {"net", "en", "com", "fr"}


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge_urls(df).collect()] == ["block", "block"]
    assert urlfilter.judge_urls(df.limit(0)).collect() == []
