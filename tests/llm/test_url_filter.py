import random

import pytest

from stepwell.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.ORG", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain(url, rules, default="allow"):
    """host, path, rule, verdict by looking at every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for h, p, v in rules:
        h = h.lower()
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p, v))
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def judged(spark, urls, rules, **more):
    rows = [(k if k % 7 else None, u, "clash", "x") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = url_filter.judge_urls(pages, rules, **more)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(str, map(tuple, got.collect()))), sorted(str((k if k % 7 else None, *plain(u, rules, **more))) for k, u in enumerate(urls))


def urls_of(rng, n):
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "org", "com", "x.com", "b.c.com", "de.net", "", "com.", "ö.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/en/", "/fr/a", "/de/b?q=/fr/", "?q", "#f", "/de/#x", "/ES/"]
    out = [None, "", "example.org/es/", "://", "http://", "x://y://org/", "http://org", "a" * 5000, "http://" + "a." * 800 + "org/" + "es/" * 2000]
    return out + [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(n)]


def test_against_all_rules(spark):
    got, want = judged(spark, urls_of(random.Random(1), 400) * 2, RULES)
    assert got == want


@pytest.mark.parametrize("rules", [[], [("org", "/", "block")] * 3, [("a.b.org", "/", "allow"), ("b.org", "/", "block"), ("b.org", "/x", "allow")]])
def test_other_rules(spark, rules):
    got, want = judged(spark, ["http://a.b.org/", "http://b.org/x", "http://c.a.b.org/xy", "", None], rules, default="block")
    assert got == want


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 50)
    rng = random.Random(3)
    rules = [(f"h{rng.randrange(60)}.org", "/" + "abc"[: rng.randrange(4)], rng.choice(["allow", "block"])) for _ in range(300)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(['', 's.'])}h{rng.randrange(60)}.org/{rng.choice(['', 'a', 'ab', 'abc', 'b'])}" for _ in range(300)]
    got, want = judged(spark, urls, rules)
    assert got == want


def test_ties_and_hot_urls(spark):
    """Equal length: the longer host, then block. A url or an empty host in very many rows."""
    rules = [("b.org", "/xx", "allow"), ("a.b.org", "/", "allow"), ("org", "/q", "allow"), ("org", "/q", "block")]
    got, want = judged(spark, ["http://a.b.org/xx", "http://z.org/q"] + ["http://a.b.org/"] * 700 + [None] * 700, rules)
    assert got == want


def test_empty_table_and_no_python(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    got = url_filter.judge_urls(pages, RULES)
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
