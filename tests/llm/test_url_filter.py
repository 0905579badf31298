import pytest

from lectern.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "https://A.EXAMPLE.com/en/742?x", "http://com/en/", "http://x.com/en", "http://xcom/en/1", "http://example.net/de/8#a",
    "http://w.example.net/de/9", "ftp://q.org/es/?", "http://é.org/es/ü", "http://user@Host.com:80/en/1", "://b.com/en/5", "http://a.com?u=http://b.net/de/", "http://deep.a.b.c.example.com/en/7/8/9",
    "http://com//en/", "http://" + "a." * 2000 + "com/en/" + "x/" * 2000,
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [r for r in rules if (host or path) and (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count(".") + bool(r.host), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("limit", [U.MAX_RULES, 0])
def test_same_as_brute_force(spark, limit):
    rules = [*U.RULES, U.Rule("", "/es/", "allow"), U.Rule("b.com", "", "block"), U.Rule("org", "/es/ü", "allow"), U.Rule("example.com", "/en/7/8", "block"), U.Rule("com", "//", "block"), U.Rule("org", "/es/", "allow")]
    pages = spark.createDataFrame([*enumerate(URLS), (0, None), (5, URLS[5])], "page_id long, url string").selectExpr("*", "'x' as host", "1 as `re.st`")
    got = U.judge_urls(pages, rules, max_rules=limit).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id], rules)


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), U.RULES).count() == 0
