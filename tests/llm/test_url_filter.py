import random

import pytest

from portloom.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "block"), ("net", "/es/x", "allow"), ("A.net", "", "allow"), (None, "/", "block"), ("org", None, "block"), ("", "/", "block")]


def plain(url, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    verdicts = {}
    for h, p, v in RULES:
        if h:
            k = h.lower(), p or ""
            verdicts[k] = max(verdicts.get(k, "allow"), v)
    fit = [(len(h + p), len(h), h + p, v) for (h, p), v in verdicts.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


@pytest.mark.parametrize("most", [url_filter.BROADCAST_RULES, 0])
def test_matches_plain_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://x.example.com/en/a?b#c", "http://WWW.Example.com/en/", "https://com?x=/en/", "http://a.net", "http://b.a.net/es/xy", "http://" + "l." * 300 + "example.com/" + "d/" * 300, "ftp://éx.org/\n/z", "x://y://z.com/"]
    for _ in range(300):
        urls.append("http://" + ".".join(rnd.choice(["a", "www", "example", "com", "net", "org"]) for _ in range(rnd.randrange(1, 5))) + "/" + rnd.choice(["", "en/", "es/", "es/x", "en", "fr/q?x#y"]))
    rows = [(i % 290 if i % 11 else None, u, "h") for i, u in enumerate(urls)] + [(1, urls[1], "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judged(pages, rules).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(map(str, ((i, *plain(u)) for i, u, _ in rows)))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.judged(pages, rules, "block").collect()] == [(None, "block")]
    assert url_filter.judged(pages.limit(0), rules).count() == 0
