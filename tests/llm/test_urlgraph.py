import pytest
from pyspark.sql import functions as F

from pagebundle.llm.urlgraph import best_rule, host_of, path_of, spread, url_digest, with_url_verdict

SCHEMA = "page_id long, url string, html string"


def link(*hosts):
    return "".join(f'<a href="http://{h}/x">' for h in hosts)


def walk(seeds, edges, steps=200, damping=0.85):
    """Dense personalised PageRank; edges: (src, dst, weight)."""
    rank = dict(seeds)
    for _ in range(steps):
        new, moved = {}, 0.0
        for src in {s for s, _, _ in edges}:
            out = [(d, w) for s, d, w in edges if s == src]
            for d, w in out:
                m = damping * rank.get(src, 0) * w / sum(x for _, x in out)
                new[d] = new.get(d, 0) + m
                moved += m
        for h, s in seeds.items():
            new[h] = new.get(h, 0) + s * (1 - moved)
        rank = new
    return rank


def test_parts_and_rules(spark):
    urls = [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/"), ("http://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://xnet/es/1", "xnet", "/es/1", None), ("http://b.com", "b.com", "", None), ("http://b.com/?x", "b.com", "/", "com/"),
        ("http://É.com?u=http://z/", "É.com", "", None), ("no scheme", "", "", None), (None, "", "", None), ("://h#x/y", "h", "", None), ("a\nb://h/p\nq", "h", "/p\nq", None),
    ]
    df = spark.createDataFrame([(u,) for u, *_ in urls], "url string")
    from pagebundle.llm.urlgraph import RULES

    got = df.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).withColumn("r", best_rule(F.col("h"), F.col("p"), RULES)["rule"]).collect()
    assert [(r["h"], r["p"], r["r"]) for r in got] == [u[1:] for u in urls]


def test_trust_and_distrust_travel_over_links(spark):
    pages = [
        (1, "http://good.com/a", link("friend.org", "mixed.org")), (2, "http://good.com/b", link("friend.org")),
        (3, "http://friend.org/a", link("good.com")), (4, "http://bad.net/es/a", None), (5, "http://bad.net/es/b", link("good.com")),
        (6, "http://feeder.org/a", link("bad.net") + link("BAD.net", "feeder.org")), (7, "http://second.org/a", link("feeder.org")),
        (8, "http://lone.org/a", "<a href='/x'>"), (9, "http://mixed.org/a", link("feeder.org", "good.com")), (10, None, link("bad.net")),
        (10, None, link("bad.net")),
    ]
    got = {r["page_id"]: r for r in with_url_verdict(spark.createDataFrame(pages, SCHEMA).withColumn("_found", F.lit(7))).collect()}
    edges = [("good.com", "friend.org", 2), ("good.com", "mixed.org", 1), ("friend.org", "good.com", 1), ("bad.net", "good.com", 1),
             ("feeder.org", "bad.net", 1), ("second.org", "feeder.org", 1), ("mixed.org", "feeder.org", 1), ("mixed.org", "good.com", 1)]
    trust = walk({"good.com": 1.0}, edges)
    distrust = walk({"bad.net": 1.0}, [(d, s, w) for s, d, w in edges])
    hosts = {"good.com", "friend.org", "bad.net", "feeder.org", "second.org", "lone.org", "mixed.org"}
    blocked = {h for h in hosts if distrust.get(h, 0) > trust.get(h, 0) and distrust.get(h, 0) * len(hosts) >= 0.5}
    assert {"bad.net", "feeder.org"} <= blocked and not blocked & {"good.com", "friend.org", "lone.org"}
    for r in got.values():
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["host"] in blocked else "allow"), r["host"]
    assert got[1]["verdict"] == "allow" and got[4]["verdict"] == "block" and got[10]["host"] == "" and got[1]["_found"] == 7


def test_hosts_far_from_every_seed_are_judged(spark):
    chain = ["bad.net"] + [f"h{k}.org" for k in range(1, 29)]
    pages = [(0, "http://bad.net/es/", None)]
    pages += [(k, f"http://{chain[k]}/", link(chain[k - 1])) for k in range(1, len(chain))]
    pages += [(1000 + k, f"http://lone{k}.org/", None) for k in range(270)]
    got = {r["page_id"]: r["verdict"] for r in with_url_verdict(spark.createDataFrame(pages, SCHEMA)).collect()}
    distrust = walk({"bad.net": 1.0}, [(chain[k - 1], chain[k], 1) for k in range(1, len(chain))])
    blocked = {k for k, h in enumerate(chain) if distrust[h] * (len(chain) + 270) >= 0.5}
    assert 20 < max(blocked) < len(chain) - 1  # further than 20 links, and not all
    assert {k for k, v in got.items() if v == "block"} == blocked


def test_walks_that_gain_mass_end_as_an_error(spark):
    edges = spark.createDataFrame([("trust", "a", "b", 3.0), ("trust", "b", "a", 3.0)], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    with pytest.raises(RuntimeError):
        spread(edges, seeds, 0.5, 0.4)


def test_empty_and_without_seeds(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_digest(none).count() == 0
    plain = spark.createDataFrame([(1, "http://a.org/", link("b.org")), (2, "http://b.org/", None)], SCHEMA)
    assert {r["verdict"] for r in url_digest(plain).collect()} == {"allow"}
