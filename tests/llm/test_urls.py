"""URL rules against a plain reading of them, the token index, odd rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tracesieve.llm import urls

ODD = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/en/1", "http://a.example.org/en/12?x=/es/",
    "http://example.org:80/es/", "http://xexample.org/es/", "http://example.org/EN/1", "http://example.org/es/#/fr/", "a://b://c.org/x",
    "http://a.com/fr/", "http://a.com/fr", "http://com/de/x", "http://acom/de/", "http://x.net/casino/", "http://x.net/CASINO/history?x", "http://x.net/casinos/",
    "http://spam-farm.example.net/a", "http://my-spam-farm.example.net/a", "http://x.net/a.exe", "http://x.net/a.exe?y", "http://x.net/?replytocom=3",
    "http://x.net/login", "http://x.net/login/x", "http://x.net/login-help", "http://é.net/ads./ñ", "http://ads.é.net/", "http://x\ny.org/z", "http://x.net/\n/poker/rules",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    low = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    fitting = []
    for r in urls.LISTED:
        of, _, start = r.text.partition("/")
        if ("." + low(host)).endswith("." + of) and path.startswith("/" + start):
            fitting.append((len(r.text), r.text, r.action))
    if fitting:
        return low(host), path, max(fitting)[1], max(fitting)[2]
    address = low(rest)
    hit = {r.action for r in urls.PATTERNS if re.search(urls.regex(r.pattern).replace(r"\z", r"\Z"), address)}
    return low(host), path, None, "block" if hit == {"block"} else "allow"


def test_odd_addresses(spark):
    rows = [(i % 20, u, 1, 2) for i, u in enumerate(ODD + ODD)]
    pages = spark.createDataFrame(rows, "page_id long, url string, judged int, fitted int")
    got = urls.filter_urls(pages)
    assert got.columns == [*pages.columns, "judged_"]
    found = sorted((r.page_id, r.url or "", tuple(r.judged_)[:4]) for r in got.collect())
    assert found == sorted((i, u or "", plain(u)) for i, u, _, _ in rows)
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, ()).select("judged_.verdict").collect()} == {"allow"}


def test_expected_verdicts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    got = {r.url: (r.judged.rule, r.judged.verdict) for r in urls.filter_urls(pages).collect()}
    assert got["HTTP://A.Example.ORG/en/1"] == ("example.org/en/1", "block") and got["http://example.org/EN/1"] == ("org/", "allow")
    assert got["http://example.org:80/es/"] == (None, "allow") and got["http://org"] == (None, "allow") and got["http://org/"] == ("org/", "allow")
    assert got["http://x.net/CASINO/history?x"] == (None, "allow") and got["http://x.net/casino/"] == (None, "block")
    assert got["http://spam-farm.example.net/a"] == (None, "block") and got["http://my-spam-farm.example.net/a"] == (None, "allow")
    assert got["http://x.net/login-help"] == (None, "allow") and got["http://x.net/login"] == (None, "block")


@pytest.mark.parametrize("pattern, tokens", [
    ("||ads.example^", ["ads", "example"]), ("/banner*ad/", []), ("/a/b1-c/", ["a", "b1", "c"]), ("foo", []), ("|http^x|", ["http", "x"]), (".exe|", ["exe"]), ("/x/1", ["x"]),
])
def test_literal_tokens(pattern, tokens):
    assert urls.literal_tokens(pattern) == tokens


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(f"x.example/common/{i}",) for i in range(50)] + [("x.example/common/rare/x",)], "address string")
    rules = (urls.Rule("/common/rare/", "block"), urls.Rule("/common/", "block"), urls.Rule("rar", "block"))
    assert {r.pattern: r.token for r in urls.token_index(pages, rules).collect()} == {"/common/rare/": "rare", "/common/": "common", "rar": ""}


def test_plan_compares_only_fetched_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = urls.filter_urls(pages)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert urls.filter_urls(pages.withColumn("verdict", F.lit(1))).count() == 1
