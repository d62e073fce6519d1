from __future__ import annotations

import math

import pytest

from basketlens.llm import url_filter as u
from compare_oracle import connect, difference

PAGES = "page_id long, url string, html string, host string, n long, `a.b` string, bound double"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, html, "h", 1, "x", 0.5) for i, (url, html) in enumerate(rows)], PAGES)


GOOD, BAD = "<p>" + "word " * 60, "<p>few words"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    return host, rest[stop:].split("?")[0].split("#")[0]


def plain_rule(host, path):
    fits = []
    for verdict, rule in u.RULES:
        domain, _, prefix = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.NET/en/x?y#z", "https://a.b.example.net/de/", "http://example.net",
    "http://example.net?/en/", "http://xexample.net/en/", "http://net/", "http://www.example.com/de/1", "http://example.com/DE/1",
    "http://example.com/de", "http://x.org/fr/#a", "http://x.org/fr#a", "a://b://c/d", "http://ÄB.org/fr/ö", "http://u@h.net:80/en/",
    "http://h.net/\n/x", "http://h.org\n/fr/x", "x://y.net/" + "a" * 100_000, "http://10.0.0.1/a", "http://[::1]/a", "http://a.co.uk/b",
]


def test_parts_and_rules_equal_the_plain_version(spark):
    df = pages(spark, [(x, GOOD) for x in URLS] + [(URLS[6], None)])
    got = {r.page_id: r for r in u.url_filter(spark, df).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "allow")


def plain_reputation(hosts, domain_of, suffix_of):
    """hosts: name -> (n, k)."""

    def total(names):
        return sum(hosts[h][0] for h in names), sum(hosts[h][1] for h in names)

    def group(key):
        out = {}
        for h in hosts:
            out.setdefault(key(h), []).append(h)
        return {g: total(names) for g, names in out.items()}

    n0, k0 = total(hosts)
    domains, suffixes = group(domain_of), group(suffix_of)
    parent = {domain_of(h): suffix_of(h) for h in hosts}

    def weight(groups, mean):
        extra = room = 0.0
        for g, (n, k) in groups.items():
            if n:
                m = mean(g, n, k)
                extra += (k - n * m) ** 2 / n - m * (1 - m)
                room += (n - 1) * m * (1 - m)
        return 1 / min(max(extra / room, u.SPREAD[0]), u.SPREAD[1]) - 1 if room else u.PRIOR_PAGES

    def top(_, n, k):
        return (k0 - k + 0.5) / (n0 - n + 1)

    w1 = weight(suffixes, top)

    def from_suffix(s, n, k):
        return (w1 * top(s, n, k) + suffixes[s][1] - k) / (w1 + suffixes[s][0] - n)

    w2 = weight(domains, lambda d, n, k: from_suffix(parent[d], n, k))

    def from_domain(h, n, k):
        d = domain_of(h)
        return (w2 * from_suffix(parent[d], n, k) + domains[d][1] - k) / (w2 + domains[d][0] - n)

    w3 = weight(hosts, from_domain)
    out = {}
    for h, (n, k) in hosts.items():
        m = from_domain(h, n, k)
        a, b = w3 * m + k, w3 * (1 - m) + n - k
        sd = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out[h] = (a / (a + b), a / (a + b) - 3 * sd)
    return out


COUNTS = {
    "a.one.com": (40, 39), "b.one.com": (30, 2), "c.one.com": (0, 0), "two.com": (500, 10), "e.two.com": (3, 3), "x.three.org": (3, 3),
    "y.three.org": (90, 88), "z.three.org": (2, 0), "four.org": (60, 1), "new.five.net": (0, 0),
}


def test_reputation_equals_the_plain_version(spark):
    rows = [(f"http://{h}/p{i}", int(i < k)) for h, (n, k) in COUNTS.items() for i in range(n)]
    rows += [(f"http://{h}/unseen", None) for h in COUNTS]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    got = {r.host: r for r in u.host_reputation(outcomes).collect()}
    want = plain_reputation(COUNTS, lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1])
    assert set(got) == set(want)
    for h, (mean, bound) in want.items():
        assert (got[h]["pages"], got[h].bad_pages) == COUNTS[h]
        assert got[h]["mean"] == pytest.approx(mean) and got[h].bound == pytest.approx(bound)
    assert got["a.one.com"].bound > u.MAX_BAD > got["b.one.com"].bound
    # Three bad pages are enough in a bad domain only.
    assert got["x.three.org"].bound > u.MAX_BAD > got["e.two.com"].bound


def test_bad_hosts_are_blocked_unless_a_rule_allows_them(spark):
    rows = [(f"http://bad.com/{i}", BAD) for i in range(60)] + [(f"http://good.com/{i}", GOOD) for i in range(60)]
    rows += [(f"http://bad.org/{'fr' if i % 2 else 'en'}/{i}", BAD) for i in range(60)]
    rows += [("http://bad.com/long", GOOD), ("http://good.com/short", None)]
    verdicts = {(r.host, r.rule, r.verdict) for r in u.url_filter(spark, pages(spark, rows)).collect()}
    assert verdicts == {
        ("bad.com", None, "block"), ("good.com", None, "allow"), ("bad.org", None, "block"), ("bad.org", "org/fr/", "allow"),
    }


def test_outcomes_of_odd_pages(spark):
    hidden = "<script>" + "word " * 99 + "</script><nav>" + "word " * 99 + "</nav><!-- " + "word " * 99 + "--><p>text</p>"
    rows = [("a", GOOD), ("b", BAD), ("c", None), ("d", ""), ("e", hidden), ("f", "<p>" + "word% " * 60), ("g", "<script " * 40_000)]
    got = {r.url: r.bad for r in u.page_outcomes(pages(spark, rows)).collect()}
    assert got == {"a": 0, "b": 1, "c": None, "d": 1, "e": 1, "f": 1, "g": 1}


def test_empty_repeated_and_one_host(spark):
    assert u.url_filter(spark, pages(spark, [])).count() == 0
    df = pages(spark, [("http://one.com/x", BAD)] * 40)
    assert u.url_filter(spark, df.union(df)).count() == 80


def test_query_equals_sql(spark):
    from basketlens.llm.queries import LLM_ORACLE, LLM_QUERIES

    path = "/root/testdata/sf0.001"
    assert difference(LLM_QUERIES["op11_url_filter"](spark, path), connect(path), LLM_ORACLE["op11_url_filter"]) == ""
