import random

import pytest

from stockloom.llm import url_filter
from stockloom.llm.url_filter import RULES


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "kept", "kept") for i, u in enumerate(urls)], "page_id long, url string, host string, n string")


def outcomes_of(spark, rows):
    return spark.createDataFrame(rows, "url string, bad int")


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://X.Example.NET/en/1?a/b", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://net/", "net", "/", "net/", "block"),
    ("http://net", "net", "", None, "allow"), ("http://a.org/fr/x#y", "a.org", "/fr/x", "org/fr/", "allow"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), ("http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("x://a?/en/", "a", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://a\nb.org/fr/\nx", "a\nb.org", "/fr/\nx", "org/fr/", "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÄX.org/fr/", "Äx.org", "/fr/", "org/fr/", "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    got = url_filter.filter_urls(pages_of(spark, [url]), outcomes_of(spark, []), RULES).collect()[0]
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def strength(groups):
    over = sum(n * (k / n - m) ** 2 - m * (1 - m) for n, k, m in groups if n)
    room = sum((n - 1) * m * (1 - m) for n, k, m in groups if n)
    rho = min(max(over / room if room else 0, 1e-4), 0.999)
    return 1 / rho - 1


def plain(hosts):
    """Posterior (a, b) by host from {host: (n, bad)}."""
    up = lambda h, k: ".".join(h.split(".")[-k:])
    add = lambda xs: tuple(map(sum, zip(*xs)))
    domains = {d: add([v for h, v in hosts.items() if up(h, 2) == d]) for d in {up(h, 2) for h in hosts}}
    suffixes = {s: add([v for d, v in domains.items() if up(d, 1) == s]) for s in {up(d, 1) for d in domains}}
    n, bad = add(suffixes.values())
    mean = bad / n
    m = strength([(*v, mean) for v in suffixes.values()])
    suffix_mean = {s: (k + m * mean) / (c + m) for s, (c, k) in suffixes.items()}
    m = strength([(*v, suffix_mean[up(d, 1)]) for d, v in domains.items()])
    domain_mean = {d: (k + m * suffix_mean[up(d, 1)]) / (c + m) for d, (c, k) in domains.items()}
    m = strength([(*v, domain_mean[up(h, 2)]) for h, v in hosts.items()])
    return {h: (k + m * domain_mean[up(h, 2)], c - k + m * (1 - domain_mean[up(h, 2)])) for h, (c, k) in hosts.items()}


def test_posteriors_against_plain_version(spark):
    rng = random.Random(6)
    hosts = {}
    for d in range(12):
        quality = rng.random()
        for h in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 3, 20, 200])
            hosts[f"h{h}.d{d}.{rng.choice(['org', 'com', 'net'])}"] = (n, sum(rng.random() < quality for _ in range(n)))
    table = spark.createDataFrame([(h, max(1, n), n, k) for h, (n, k) in hosts.items()], "host string, pages long, n long, bad long")
    got = {r.host: (r.a, r.b) for r in url_filter.reputations(table).collect()}
    want = plain(hosts)
    assert got.keys() == want.keys()
    assert all(got[h] == pytest.approx(want[h], rel=1e-9) for h in want)


def test_bad_hosts_are_blocked_and_their_likes_without_labels(spark):
    urls = [f"http://s{i % 3}.spam.org/en/{i}" for i in range(60)] + [f"http://g{i % 3}.good.org/en/{i}" for i in range(60)] + ["http://new.spam.org/"]
    told = [(u, 1) for u in urls[:60]] + [(u, 0) for u in urls[60:120]] + [(None, 1), ("http://s0.spam.org/", None)]
    got = url_filter.filter_urls(pages_of(spark, urls), outcomes_of(spark, told), RULES).collect()
    assert all((r.verdict == "block") == ("spam" in r.url) for r in got)


def test_hosts_with_mostly_bad_pages_are_blocked_at_the_limits_of_the_query(spark):
    urls = [f"http://h{h}.d{h}.org/en/{i}" for h in range(8) for i in range(30)]
    told = [(u, int(i % 30 < (26 if i < 60 else 3))) for i, u in enumerate(urls)]
    got = url_filter.filter_urls(pages_of(spark, urls), outcomes_of(spark, told), RULES, limit=0.5, z=1.645).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"h0.d0.org", "h1.d1.org"}
    assert all(r.rule is None and (r.verdict == "block") == (r.bad_share_bound is not None) for r in got)


def test_labels_reach_pages_by_the_number_in_the_url(spark):
    pages = pages_of(spark, ["http://a.org/en/12?x", "http://a.org/en/13.html", "http://a.org/en/14x", "http://a.org/12", None, "http://a.org/de/12/"])
    labels = spark.createDataFrame([(12, 1, 0), (12, 1, 1), (13, 1, 0), (14, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.labelled_outcomes(pages, labels).collect()
    assert sorted((r.url, r.bad) for r in got) == [("http://a.org/de/12/", 1), ("http://a.org/en/12?x", 1), ("http://a.org/en/13.html", 0), ("http://a.org/en/14x", 1)]


def test_empty_table(spark):
    assert url_filter.filter_urls(pages_of(spark, []), outcomes_of(spark, []), RULES).count() == 0
