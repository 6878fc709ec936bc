"""URL filters against every rule for every URL."""

import random

import pytest

from millrace.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "allow"),
         ("example.net", "/en/x", "block"), ("b-c.net", "/", "allow"), ("xample.net", "/", "block"), ("Deep.A.Example.net", "/e", "block")]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rows_a_range", [500_000, 7])
def test_every_rule(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", rows_a_range)
    rng = random.Random(4)
    hosts = ["example.net", "EXAMPLE.net", "a.example.net", "deep.a.example.net", "b.deep.a.example.net", "b-c.net", "xexample.net", "example.com", "m.example.com", "org", "x.org", "net", "nets", "é.net", "example.net:80", "", "a..net", "."]
    urls = [None, "", "nothing", "://", "http://", "x://net", "https://net?x://org/fr/", "a\nb://net/\n/x"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x/y', '/de/1', '/fr/2?q', '/e#f', '?x=/en/', '#/'])}" for _ in range(300)]
    urls += ["http://example.net/en/"] * 120
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert out == {i: plain(u) for i, u in enumerate(urls)}


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, "block").collect()] == [(None, "block")] * 2
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0
