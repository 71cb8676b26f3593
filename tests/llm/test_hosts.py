import pytest

from dnsq.llm import hosts as H

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
URLS = [None, "", "no scheme", "://", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://a.b.example.com/en/1",
        "https://example.com", "https://example.com?q=/en/", "https://notexample.com/en/1", "ftp://x.net/es/1://y", "https://x.net/es",
        "https://x.net/en/1", "https://new.org/a#b?c", "https://com/", "https://ü.NET/es/ñ\n", "https://x.net/en/1"]
WANT = [("", "", None), ("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/x", "example.com/en/"),
        ("www.example.com", "/en/", "www.example.com/en/"), ("a.b.example.com", "/en/1", "example.com/en/"), ("example.com", "", None),
        ("example.com", "", None), ("notexample.com", "/en/1", "com/"), ("x.net", "/es/1://y", "net/es/"), ("x.net", "/es", None),
        ("x.net", "/en/1", None), ("new.org", "/a", None), ("com", "/", "com/"), ("ü.net", "/es/ñ\n", "net/es/"), ("x.net", "/en/1", None)]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, domain string, a string").repartition(3)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in H.judge(frame(spark, URLS), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == WANT
    assert len(got) == len(URLS) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert got[12].verdict == got[16].verdict


def posteriors(outcomes):
    """The same estimates in plain Python."""
    hosts = {}
    for h, bad in outcomes:
        n = hosts.setdefault(h, [0, 0])
        if bad is not None:
            n[0] += 1
            n[1] += bad
    domain = lambda h: ".".join(h.split(".")[-2:])

    def grouped(key, counts):
        out = {}
        for k, (n, b) in counts.items():
            x = out.setdefault(key(k), [0, 0])
            x[0] += n
            x[1] += b
        return out

    domains = grouped(domain, hosts)
    suffixes = grouped(lambda d: d.split(".")[-1], domains)
    n, b = map(sum, zip(*suffixes.values()))
    centre = (b + 1) / (n + 2) if n else 0.5

    def strength(level):
        some = [v for v in level.values() if v[0]]
        total, spread = sum(x for x, _ in some), 0.5
        if len(some) > 1:
            chance = centre * (1 - centre)
            room = chance * (total - sum(x * x for x, _ in some) / total - (len(some) - 1))
            if room > 0:
                spread = (sum(y * y / x for x, y in some) - total * centre**2 - chance * (len(some) - 1)) / room
        return 1 / min(0.5, max(0.01, spread)) - 1

    ms, md, mh = strength(suffixes), strength(domains), strength(hosts)
    s = {k: (ms * centre + y) / (ms + x) for k, (x, y) in suffixes.items()}
    d = {k: (md * s[k.split(".")[-1]] + y) / (md + x) for k, (x, y) in domains.items()}
    return {k: (mh * d[domain(k)] + y, mh * (1 - d[domain(k)]) + x - y) for k, (x, y) in hosts.items()}


def test_reputation_like_plain_python(spark):
    outcomes = [("a.x.net", 1)] * 20 + [("b.x.net", 1)] * 2 + [("c.x.net", None)] * 3 + [("d.y.net", 0)] * 30 + [("d.y.net", 1)]
    outcomes += [("z.org", 0)] * 8 + [("q.org", None), ("", None), ("single", 1)]
    df = spark.createDataFrame(outcomes, "host string, bad int").repartition(4)
    got = {r.host: (r.a, r.b) for r in H.reputation(df).collect()}
    want = posteriors(outcomes)
    assert set(got) == set(want) and all(got[h] == pytest.approx(want[h]) for h in want)
    mean = {h: a / (a + b) for h, (a, b) in got.items()}
    assert mean["a.x.net"] > mean["b.x.net"] > mean["c.x.net"] > mean["q.org"] and mean["d.y.net"] < 0.2


def test_no_labels_and_empty_table(spark):
    got = H.judge(frame(spark, ["https://x.org/a", "https://y.org/b"]), RULES).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert H.judge(frame(spark, []), RULES).count() == 0


def test_pages_beside_a_path_rule_are_good_outcomes(spark):
    urls = [f"https://clean.net/{'es' if i == 0 else 'en'}/{i}" for i in range(40)] + [f"https://foul.net/es/{i}" for i in range(40)]
    urls += ["https://foul.net/en/1"] + [f"https://x{i}.com/" for i in range(5)]
    got = [r.verdict for r in H.judge(frame(spark, urls), RULES).orderBy("page_id").collect()]
    assert got[0] == "block" and set(got[1:40]) == {"allow"}  # the host decides, not the suffix
    assert set(got[40:81]) == {"block"} and set(got[81:]) == {"allow"}


def test_registered_domains_below_two_label_suffixes(spark):
    outcomes = [("www.bad.co.uk", 1)] * 30 + [("good.co.uk", 0)] * 30 + [("co.uk", None), ("a.bad.co.uk", None), ("a.good.co.uk", None)]
    outcomes += [("b.bad.org", 1)] * 3 + [("org", 0)] * 3
    got = {r.host: r.a / (r.a + r.b) for r in H.reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert set(got) == {h for h, _ in outcomes}
    assert got["a.bad.co.uk"] > 0.5 > got["a.good.co.uk"]
