from tidefold.llm.url_filter import DISTRUST, TRUST, UNITS, filter_urls, propagate
from tidefold.session import Scratch

PAGES = "page_id long, url string, html string"


def test_host_path_and_longest_rule(spark):
    cases = {
        "HTTP://WWW.Shop.NET/a?b": ("www.shop.net", "/a", "net/", "block"),
        "http://x.example.net/en/1#t": ("x.example.net", "/en/1", "example.net/en/", "allow"),
        "http://x.example.net/fr/1": ("x.example.net", "/fr/1", "net/", "block"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://a.org?q=://b.net/": ("a.org", "", None, "allow"),
        "http://a.net": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "ÄB://Ä.ORG/fr/x": ("Ä.org", "/fr/x", "org/fr/", "allow"),
        "://": ("", "", None, "allow"),
    }
    rows = [(i, url, None) for i, url in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'y' AS rule")
    got = [tuple(r)[1:5] for r in filter_urls(df).orderBy("page_id").collect()]
    assert got[::2] == got[1::2] == list(cases.values())
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_distrust_reaches_who_links_to_blocked_hosts(spark):
    link = "<a HREF = 'https://{}/x'>".format
    pages = [
        (1, "http://bad.net/", ""),
        (2, "http://farm.com/", link("BAD.net") + link("bad.net")),
        (3, "http://good.org/fr/", link("friend.com")),
        (4, "http://friend.com/", ""),
        (5, "http://lone.com/", "<a href=/here>"),
    ]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > got[2]["trust"]
    assert got[4]["verdict"] == "allow" and got[4]["trust"] > 0
    assert got[5]["verdict"] == "allow" and got[5]["trust"] == got[5]["distrust"] == 0


def test_ranks_equal_a_loop(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")]
    seeds = {(TRUST, "a"): UNITS, (DISTRUST, "c"): UNITS // 2, (DISTRUST, "b"): UNITS // 2}
    want = dict(seeds)
    for _ in range(5):
        new = {key: value * 15 // 100 for key, value in seeds.items()}
        for (walk, host), rank in want.items():
            out = [t for s, t in edges if s == host] if walk == TRUST else [s for s, t in edges if t == host]
            for to in out:
                new[walk, to] = new.get((walk, to), 0) + rank * 85 // (100 * len(out))
        want = new
    seed_rows = spark.createDataFrame([(*k, v) for k, v in seeds.items()], "_walk int, host string, seed long")
    got = propagate(spark.createDataFrame(edges, "src string, dst string"), seed_rows, Scratch(spark), steps=5)
    assert {(r["_walk"], r["host"]): r["rank"] for r in got.collect()} == want
