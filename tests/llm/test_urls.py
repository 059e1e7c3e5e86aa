"""Verdicts on URLs, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from mixframe.llm import urls
from mixframe.llm.catalog import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = re.match(r"[^#]*", rest[len(host) + len(path) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path, query


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://com/", "http://com", "http://telecom/", "a://b://c/d",
        "http://x.net/es/?a=1#f", "http://x.net/ES/", "http://É.org/a\nb?q#z", "http://example.com/en/", "http://user@h.org:80/p//", "http://a.org?utm_source=1&b=2",
        "http://www.a.org/?b=2&utm_x=3#t", "http://example.com.evil.org/en/"]


def test_verdicts(spark):
    random.seed(1)
    made = [f"http://h{random.randrange(30)}.org/p{random.randrange(80)}{random.choice(['', '/', '?utm_a=1', '#x'])}" for _ in range(600)]
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS + made + made[:50] + ["http://hot.org/a"] * 200)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, host string, canonical int")
    listed_urls = made[::3] + ["http://www.a.org/?b=2", "http://hot.org/a/"]
    part = urls.parts_of(F.col("url"))
    listed = spark.createDataFrame([(u,) for u in listed_urls] + [(None,)], "url string")
    listed = listed.select(urls.canonical(part["host"], part["path"], part["query"]).alias("canonical"))
    known = {r.canonical for r in listed.collect()} - {"", None}
    for limit in (0, 1 << 20):  # filter joined by shuffle, and broadcast
        found = urls.judge(table, listed, URL_RULES, ["page_id"], limit=limit).collect()
        assert len(found) == len(rows)
        for r in found:
            host, path, _ = parts(rows[r.page_id][1])
            rule = rule_of(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
            assert r.verdict == (rule.verdict if rule else "block" if r.canonical in known else "allow")
            assert r.possible or not r.listed
    assert sum(r.possible and not r.listed for r in found) < 0.05 * len(found)


def test_empty(spark):
    table = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "canonical string")
    assert [r.verdict for r in urls.judge(table, none, [], ["page_id"]).collect()] == ["allow"]
    assert urls.judge(table.limit(0), none, URL_RULES, ["page_id"]).collect() == []


def test_main_path_is_native(spark, folder):
    from mixframe.llm import catalog

    for query in (catalog.op1_chat, catalog.op9_urls):
        plan = query(spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
