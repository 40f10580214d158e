"""URL rules against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from phasemill.llm import queries as Q
from phasemill.llm import url_rules as U

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://COM", "http://com/", "http://Com/?x", "http://a.com?/", "http://a.com#/", "http://example.com/en", "http://example.com/en/", "http://WWW.Example.com/en/a//b/", "http://xexample.com/en/a",
    "http://net/es/", "http://a.b.net/fr/x#y", "http://net./es/", "http://.net/es/", "http://..net/fr/", "http://net:80/es/", "a://b://net/es/", "http://net/ES/", "ftp://É.net/es/ß\n/x", "http://user@net/fr/", "x" * 40_000, "http://a.net/" + "es/" * 20_000, "http://" + "a." * 20_000 + "net/es/",
]


def _plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_urls_by_rules(spark, limit):
    rng = random.Random(7)
    hosts, paths = ["a", "b.a", "c.b.a", "ab.a", ""], ["/", "/p", "/p/", "/p/q", "/p/q/", ""]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(12)]
    made = [f"s://{rng.choice(['', 'd.', 'ab.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/q/r', '?/p', '#'])}" for _ in range(300)]
    for urls, rows in ((URLS, Q.URL_RULES), (made, rules)):
        ids = [*range(len(urls)), None]
        pages = spark.createDataFrame([(k, u, "h") for k, u in zip(ids, [*urls, urls[-1]], strict=True)], "page_id long, url string, `rule.x` string").withColumn("_row", F.lit("mine")).withColumn("prefix", F.lit("mine"))
        pages = pages.union(pages.limit(3))
        got = U.judged(pages, spark.createDataFrame(rows, U.RULES_SCHEMA), carry=("rule.x", "_row", "prefix"), broadcast_rules=limit)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict", "rule.x", "_row", "prefix"]
        want = [(r.page_id, *_plain(r.url, rows), "h", "mine", "mine") for r in pages.collect()]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    none = spark.createDataFrame([], U.RULES_SCHEMA)
    assert [tuple(r) for r in U.judged(pages, none, default="block").collect()] == [(1, "a", "/", None, "block")]
    assert U.judged(pages.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, "/", "block"), ("a", None, "allow"), ("A", "/", "allow"), ("a", "/", "block")], U.RULES_SCHEMA)
    assert [tuple(r) for r in U.judged(pages, odd).collect()] == [(1, "a", "/", "a/", "block")]
    with pytest.raises(Exception, match="not a verdict"):
        U.judged(pages, spark.createDataFrame([("a", "/", "maybe")], U.RULES_SCHEMA)).collect()
