"""URL rules against a plain loop over all rules."""

import re

from sedge.llm import urls as U

RULES = [U.listed("allow", "org", "/"), U.listed("block", "example.org", "/es/"), U.listed("block", "example.org", "/en/1"), U.listed("allow", "com", "/fr/"), U.listed("block", "com", "/de/"), *map(U.unwanted, U.UNWANTED)]
URLS = [
    None, "", "no scheme", "x" * 200_000, "http://" + "h." * 60_000 + "org/",  "http://", "http://org", "http://org/", "HTTP://EXAMPLE.ORG/es/x", "https://www.example.org/es", "https://a.example.org/es/", "https://example.org/en/12?x=/es/",
    "https://example.org/en/2#/", "https://notexample.org/es/1", "https://x.com/fr/a", "https://x.com/de/", "https://com/de/é", "https://x.com/FR/a", "https://adult-x.com/a", "https://adult-x.com/fr/a",
    "https://xadult.com/", "ftp://u@casino.net:80/p?q=http://org/", "a://b://c/d", "http://h?x=1/fr/", "http://com/fr/" + "y" * 100_000, "http://ex\nample.org/es/", "://porn", "http://XXX", "https://example.org//es/",
    "http://ÀÉ.org/é", "https://.org/", "https://example.com/fr/a://org/",
]


def plain(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    table = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if set(re.split(r"[.-]", host)) & set(U.UNWANTED) else "allow"


def test_same_as_all_rules(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS)] + [(1, URLS[8], "x", "y")] * 3 + [(None, URLS[6], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, token string").repartition(3)
    got = sorted(map(tuple, U.judge_urls(df, "page_id", "url", RULES).collect()), key=repr)
    assert got == sorted(((k, *plain(u)) for k, u, _, _ in rows), key=repr)


def test_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in U.judge_urls(df, "page_id", "url", [], "block").collect()] == [(1, "a.org", "/x", None, "block")]
    assert U.judge_urls(df.filter("false"), "page_id", "url", RULES).count() == 0


def test_many_rules_are_joined_as_a_table(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 2)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = sorted(map(tuple, U.judge_urls(df, "page_id", "url", RULES).collect()), key=repr)
    assert got == sorted(((k, *plain(u)) for k, u in enumerate(URLS)), key=repr)


def test_rules_wait_under_their_rarest_token(spark):
    rows = [("example.org", "/es/1")] * 5 + [("x.com", "/fr/")]
    seen = spark.createDataFrame(rows, "host string, path string")
    tokens = seen.select(U.url_tokens(seen["host"], seen["path"]).alias("tokens"))
    filed = {r["name"]: r["token"] for r in U.file_rules(RULES, tokens).collect() if r["name"]}
    assert filed["com/fr/"] in ("host:com", "path:fr") and filed["com/de/"] == "path:de" and filed["example.org/en/1"] == "path:en"


def test_rules_without_tokens(spark):
    df = spark.createDataFrame([(1, "http://a/b"), (2, "nothing")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(df, "page_id", "url", [U.listed("block", "", "/")]).collect()}
    assert got == {1: "block", 2: "allow"}
