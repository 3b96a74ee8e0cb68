"""Rules and propagation on a small web."""

from plumbline.llm import urls
from plumbline.llm.queries import RULES

LINK = '<a href="{}">x</a>'


def page(i, url, *targets):
    return (i, url, "<p>" + "".join(LINK.format(t) for t in targets))


def slow(rows, rules, rounds=20):
    """The same with plain dictionaries."""
    import math
    import re

    def parse(url):
        head, sep, rest = (url or "").partition("://")
        if not sep:
            return "", ""
        name = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in name), re.match(r"[^?#]*", rest[len(name) :])[0]

    out, edges, seeds = {}, {}, {}
    for i, url, html in rows:
        host, path = parse(url)
        best = None
        for rule, verdict in rules:
            name, _, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (not best or len(rule) > len(best[0])):
                best = (rule, verdict)
        out[i] = (host, path, best)
        if best:
            seeds[best[1], host] = seeds.get((best[1], host), 0) + 1
        for target in re.findall(r'href="(?:[a-z]+:)?//([^"/?#]+)', html or ""):
            if host and target.lower() != host:
                edges[host, target.lower()] = edges.get((host, target.lower()), 0) + 1
    ranks = {}
    for kind in ("allow", "block"):
        ways = {(a, b) if kind == "allow" else (b, a): n for (a, b), n in edges.items()}
        whole = {}
        for (a, _), n in ways.items():
            whole[a] = whole.get(a, 0) + n
        start = {h: math.floor(n * urls.UNIT * (1 - urls.DAMPING)) for (k, h), n in seeds.items() if k == kind}
        rank = dict(start)
        for _ in range(rounds):
            new = dict(start)
            for (a, b), n in ways.items():
                if a in rank:
                    new[b] = new.get(b, 0) + math.floor(rank[a] * (urls.DAMPING * n / whole[a]))
            rank = new
        ranks[kind] = rank
    result = {}
    for i, (host, path, best) in out.items():
        trust, distrust = (ranks[k].get(host, 0) for k in ("allow", "block"))
        verdict = best[1] if best else "block" if trust < 0.5 * (trust + distrust) else "allow"
        result[i] = (host, path, best[0] if best else None, verdict)
    return result


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS _host")
    return {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, RULES).collect()}


def test_propagation_against_dictionaries(spark):
    rows = [
        page(1, "https://good.org/", "https://friend.net/a", "//Friend.NET/b", "/local"),
        page(2, "https://good.org/x", "https://hub.net/"),
        page(3, "http://friend.net/1", "http://second.net/"),
        page(4, "http://second.net/"),
        page(5, "http://bad.com/de/1", "http://good.org/"),
        page(6, "http://farm.net/", "http://bad.com/de/2", "http://bad.com/de/1"),
        page(7, "http://farmer.net/", "http://farm.net/"),
        page(8, "http://hub.net/", "http://bad.com/", "http://friend.net/"),
        page(9, "http://alone.net/"),
        page(10, "http://bad.com/en/"),
        *[page(20 + i, f"http://s{i % 5}.net/{i}", f"http://s{(i * 3 + 1) % 7}.net/", "http://bad.com/", "https://good.org/") for i in range(30)],
    ]
    got = judged(spark, rows)
    assert got == slow(rows, RULES)
    assert got[6][3] == got[7][3] == got[10][3] == "block"
    assert got[3][3] == got[4][3] == got[9][3] == "allow"


def test_rules_and_odd_urls(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q#f", None), (2, "x://example.org/es", ""), (3, "x://example.org/en/12", ""), (4, "x://notexample.org/es/", ""),
        (5, "x://www.b.com/fr/", ""), (6, "x://b.com/de/", ""), (7, "x://org", ""), (8, None, ""), (9, "no url", ""), (10, "x://com/fr/?a", ""),
        (11, "://h.org/p?u=x://y.com/de/", ""), (12, "x://user@Ö.org:80/", ""), (13, "x://example.org?/es/", ""), (14, "", None),
    ]
    got = judged(spark, rows)
    assert got == slow(rows, RULES)
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[7] == ("org", "", None, "allow")
    assert judged(spark, []) == {}


def test_small_shares_and_far_hosts_count(spark):
    """A blocked page that 200 000 hosts link to, and a chain of 26 hosts that ends there."""
    fans = spark.range(200_000).selectExpr("concat('fan', id) AS src", "'bad' AS dst", "1L AS n")
    chain = spark.range(26).selectExpr("concat('far', id + 1) AS src", "if(id = 0, 'fan7', concat('far', id)) AS dst", "1L AS n")
    seeds = spark.createDataFrame([("bad", "block", 1)], "host string, kind string, pages bigint")
    scores = urls.propagate(fans.unionByName(chain), seeds)
    assert scores.where("trust = 0 AND distrust > 0").count() == 200_027
    found = {r["host"]: r["distrust"] for r in scores.where("host IN ('fan3', 'far26')").collect()}
    assert abs(found["fan3"] / (0.15 * 0.85 / 200_000) - 1) < 1e-6
    assert abs(found["far26"] / (0.15 * 0.85**27 / 200_000) - 1) < 1e-6


def exact_ranks(edges, seeds):
    """Trust and distrust by rounds of plain Python, until nothing changes."""
    ranks = {}
    for kind in ("allow", "block"):
        ways = {(a, b) if kind == "allow" else (b, a): n for a, b, n in edges}
        whole = {}
        for (a, _), n in ways.items():
            whole[a] = whole.get(a, 0) + n
        start = {h: n * (1 - urls.DAMPING) for h, k, n in seeds if k == kind}
        rank = dict(start)
        for _ in range(400):
            new = dict(start)
            for (a, b), n in ways.items():
                if a in rank:
                    new[b] = new.get(b, 0.0) + rank[a] * urls.DAMPING * n / whole[a]
            rank = new
        ranks[kind] = rank
    return ranks


def web(seed):
    """Cycles, a hub, a chain and random links."""
    import random

    rng = random.Random(seed)
    edges = [("good", "ring0", 1), ("ring2", "good", 1), ("ring1", "bad", 1), ("bad", "ring0", 2)]
    edges += [(f"ring{i}", f"ring{(i + 1) % 3}", 2) for i in range(3)]
    edges += [("hub", f"leaf{i}", 1) for i in range(40)] + [(f"leaf{i}", "hub", 3) for i in range(0, 40, 2)] + [("good", "hub", 1)]
    edges += [(f"far{i + 1}", f"far{i}", 1) for i in range(12)] + [("far0", "bad", 1)]
    edges += list({(a, b): (a, b, rng.randint(1, 4)) for a, b in ((f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(60)) if a != b}.values())
    edges += [("good", "n1", 1), ("n2", "bad", 1), ("n3", "bad", 1), ("good", "n4", 2)]
    return edges, [("good", "allow", 3), ("bad", "block", 2)]


def test_cycles_hubs_and_chains(spark):
    edges, seeds = web(1)
    df = spark.createDataFrame(edges, "src string, dst string, n bigint").repartition(4)
    of = spark.createDataFrame(seeds, "host string, kind string, pages bigint")
    ranks = exact_ranks(edges, seeds)
    for threshold in (None, 0.5):
        found = {r.host: (r.trust, r.distrust) for r in urls.propagate(df, of, threshold=threshold).collect()}
        assert set(found) == set(ranks["allow"]) | set(ranks["block"])
        for host, (trust, distrust) in found.items():
            t, d = ranks["allow"].get(host, 0.0), ranks["block"].get(host, 0.0)
            assert (trust < 0.5 * (trust + distrust)) == (t < 0.5 * (t + d)) or abs(t - d) < 1e-6 * t, host
            if threshold is None:
                assert abs(trust - t) <= 1e-5 * t and abs(distrust - d) <= 1e-5 * d


def test_a_cycle_takes_few_jobs(spark):
    """Two hosts that link to each other, one trusted and one blocked: 107 rounds to the last digit."""
    rows = [page(1, "https://a.org/", "http://b.com/"), page(2, "http://b.com/de/", "https://a.org/"), page(3, "http://c.net/", "http://b.com/", "https://a.org/")]
    calls = []
    real = urls.materialise
    try:
        urls.materialise = lambda df, label: calls.append(label) or real(df, label)
        found = judged(spark, rows)
    finally:
        urls.materialise = real
    assert found[1][3] == "allow" and found[2][3] == "block" and found[3][3] == "block"
    assert calls.count("url-ranks") <= 12
