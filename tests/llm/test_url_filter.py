from collections import defaultdict

from runlens.llm import url_filter
from runlens.llm.url_filter import Rule

SCHEMA = "page_id long, url string, html string, host string, id string, rule int, kind string, mass int, salt int"
RULES = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "i", 1, "k", 2, 3) for r in rows], SCHEMA).repartition(2)


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://Example.COM/en/a?q=/x#f": ("example.com", "/en/a", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.www.example.com/en/x": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://blog.example.com/en": ("blog.example.com", "/en", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://example.com": ("example.com", "", None, "allow"),
        "https://example.com?x=/en/": ("example.com", "", None, "allow"),
        "x://a://b/c": ("a:", "//b/c", None, "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "http://É.COM/\nes/": ("É.com", "/\nes/", "com/", "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, url, None) for i, url in enumerate(cases)] + [(None, None, ""), (0, "x://b.net/es/1", "x")]
    got = url_filter.judge(frame(spark, rows), RULES).collect()
    want = [(i, *v) for i, v in enumerate(cases.values())] + [(None, "", "", None, "allow"), (0, "b.net", "/es/1", "net/es/", "block")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert url_filter.judge(frame(spark, []), RULES).collect() == []


def masses(links, seeds):
    out = {}
    for kind in ("trust", "distrust"):
        edges = {(a, b) if kind == "trust" else (b, a) for a, b in links}
        degree = defaultdict(int)
        for a, _ in edges:
            degree[a] += 1
        own = [h for h, k in seeds.items() if k == kind]
        mass = {h: url_filter.MASS // len(own) for h in own}
        start = dict(mass)
        for _ in range(url_filter.ROUNDS):
            step = {h: m * (100 - url_filter.FLOW) // 100 for h, m in start.items()}
            for a, b in edges:
                if a in mass:
                    step[b] = step.get(b, 0) + mass[a] * url_filter.FLOW // 100 // degree[a]
            mass = step
        for h, m in mass.items():
            out[h, kind] = m
    return out


def test_flow_equals_brute_force(spark):
    links = [(f"h{a}.org", f"h{b}.org") for a, b in ((1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 5), (2, 6), (7, 8), (8, 7), (1, 6))]
    seeds = {"h1.org": "trust", "h7.org": "trust", "h3.org": "distrust"}
    got = url_filter.propagate(
        spark.createDataFrame(links, "source string, target string"), spark.createDataFrame(list(seeds.items()), "host string, kind string")
    ).collect()
    assert {(r["host"], r["kind"]): r["mass"] for r in got} == masses(links, seeds)


def test_links_decide_where_rules_do_not(spark):
    def to(*hosts):
        return "".join(f"<a HREF = 'https://{h}/x?y'>t</a><a href=/own><a href=\"//{h}\">" for h in hosts)

    rows = [
        (1, "http://good.com/a", to("friend.org", "friend.org")),
        (2, "http://friend.org/a", to("second.org")),
        (3, "http://second.org/a", ""),
        (4, "http://bad.net/es/a", ""),
        (5, "http://bad.net/es/b", None),
        (6, "http://bad.net/other", ""),
        (7, "http://farm.org/", to("bad.net")),
        (8, "http://behind.org/", to("farm.org")),
        (9, "http://neutral.org/", "<a href='/x'>"),
    ]
    got = {r["id"]: r["verdict"] for r in url_filter.judge(frame(spark, rows), RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow"}
