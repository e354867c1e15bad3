import random

import pytest
from pyspark.sql import functions as F

from cellfold.llm.queries import ORACLES, RULES, op9_url_filter
from cellfold.llm.urlfilter import Rule, filter_urls

from tests.conftest import SF, comparable


def judge(url, rules):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.partition("://")[2]
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.partition(c)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (r.host == "" or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and r.path[:1] in ("", "/")]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.name), r.verdict == "block", r.name))
    return host, path, best.name, best.verdict


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.Example.ORG/en/12?x#y", "https://badexample.org/es/", "ftp://x.example.org/es/a", "http://example.org#/es/", "http://example.org?/es/", "http://example.org/ES/", "a://b://c.org/d", "http://exampleXorg/es/", "http://com/fr/x/../de/", "http://u@x.com:80/de/", "http://x.com/de/", "http://a\nb.org/x\ny", "http://日本.org/", "http://org./"]
ALL = [*RULES, Rule("", "/admin/", "block"), Rule("x.com", "", "block"), Rule("", "/de", "allow"), Rule("a+b.net", "/(c)", "block"), Rule("org", "es/", "block"), Rule("x.com", "/de/", "block"), Rule("x.com", "/de/", "allow")]


@pytest.mark.parametrize("rules", [RULES, ALL, ()], ids=["five", "many", "none"])
def test_like_trying_every_rule(spark, rules):
    rng = random.Random(2)
    hosts, paths = ["org", "example.org", "www.example.org", "x.com", "y.x.com", "a+b.net", "aab.net", "net"], ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/", "/de/a", "/admin/", "/(c)d", "/adminx"]
    urls = [*URLS, *(f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(300))]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(None, "http://org/", "k"), (3, "http://org/", "k"), (3, "http://org/", "k")], "page_id long, url string, token string")
    rows = filter_urls(pages, rules).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url, rules), r.url


def test_clashing_and_empty(spark):
    with pytest.raises(ValueError, match="host"):
        filter_urls(spark.createDataFrame([("u", "h")], "url string, host string"), RULES)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_rules_in_a_table(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in ALL], "host string, path string, verdict string")
    assert comparable(filter_urls(pages, table).toPandas()) == comparable(filter_urls(pages, ALL).toPandas())


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    first = filter_urls(pages, ALL).toPandas()
    monkeypatch.setattr("cellfold.llm.urlfilter.BROADCAST_RULES", 0)
    assert comparable(filter_urls(pages, ALL).toPandas()) == comparable(first)


def test_query(spark, duck):
    assert comparable(op9_url_filter(spark, SF).toPandas()) == comparable(duck.sql(ORACLES["op9_url_filter"]).df())


def test_long_urls_and_clashing_names(spark):
    rows = [(1, "http://a.org/" + "x/" * 600_000, "k"), (2, "http://" + "s." * 100_000 + "a.org/x/", "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, __key string").withColumn("best", F.lit(1)).withColumn("token", F.lit(2))
    found = filter_urls(frame, [Rule("a.org", "/x/", "block")])
    assert found.columns == ["page_id", "url", "__key", "best", "token", "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.rule, r.verdict, r["__key"], r.best) for r in found.collect()} == {(1, "a.org/x/", "block", "k", 1), (2, "a.org/x/", "block", "k", 1)}
