import re

from folioflux.llm import url_filter as u
from folioflux.sources.tables import load


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(url, rules):
    host, path = parse(url)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


def ranks(seeds, edges, d=u.DAMPING, tolerance=u.TOLERANCE):
    total, out = sum(seeds.values()), {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    base = {h: s * (1 - d) for h, s in seeds.items()}
    score, change = dict(base), 1
    while total and edges and change > tolerance:
        new = dict(base)
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + d * score.get(a, 0) * n / out[a]
        change = sum(abs(v - score.get(h, 0)) for h, v in new.items()) / total
        score = new
    return score


def brute(pages, rules):
    hosts, edges = {}, {}
    for _, url, html in pages:
        h, _ = parse(url)
        hosts.setdefault(h, []).append(rule_of(url, rules)[1])
        for to in re.findall(r"""href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#>\s]+)""", html or "", re.I):
            to = to.lower()
            if h and to != h:
                edges[h, to] = edges.get((h, to), 0) + 1
    share = lambda v: {h: x.count(v) / len(x) for h, x in hosts.items() if h and x.count(v) * 2 >= len(x)}
    trust, distrust = ranks(share("allow"), edges), ranks(share("block"), {(b, a): n for (a, b), n in edges.items()})
    out = []
    for k, url, _ in pages:
        h, p = parse(url)
        rule, verdict = rule_of(url, rules)
        out.append((k, h, p, rule, verdict or ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")))
    return sorted(out, key=repr)


PAGES = [
    (1, "https://Good.org/x?y", '<a href="https://a.net/1">'),
    (2, "http://a.net/p#f", "<a href='//b.net/2'><a HREF=http://c.net>"),
    (3, "http://b.net", None),
    (4, "http://bad.com/de/1", "x"),
    (5, "http://link.net/q", '<a href="http://bad.com/de/1">' * 3 + '<a href="/self">'),
    (6, "http://far.net/q", '<a href="http://link.net/">'),
    (7, None, "<a href='//b.net/2'>"),
    (8, "no scheme", ""),
    (9, "http://example.org/en/12", ""),
    (10, "http://www.example.org/es/", ""),
    (11, "http://example.org", ""),
    (12, "http://notexample.org/es/", ""),
    (13, "", ""),
    (1, "https://good.org/x?y", ""),
    (None, "http://both.net/", '<a href="http://bad.com/"><a href="http://a.net/">'),
]


def test_graph_against_brute_force(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(u.RULES, "verdict string, rule string")
    got = u.filter_urls(pages, rules).select("_row.page_id", "host", "path", "rule", "verdict").collect()
    want = brute(PAGES, u.RULES)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {v for k, *_, v in want if k in (5, 6)} == {"block"} and [v for k, *_, v in want if k == 2] == ["allow"]
    assert u.filter_urls(pages.limit(0), rules).count() == 0
    assert u.filter_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_query_on_the_table(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in load(spark, sf_dir, "pages").collect()]
    assert sorted((tuple(r) for r in u.op8_url_filter(spark, sf_dir).collect()), key=repr) == brute(pages, u.RULES)


def chain(n, seeds):
    """A trusted host, links from one host to the next, and at the end one that a blocked host's mirror links to."""
    pages = [(0, "http://s0.org/", '<a href="http://h1.net/">')]
    pages += [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(1, n)]
    return pages + [(1000 + i, f"http://t{i}.org/", "") for i in range(seeds)]


def test_far_hosts_and_many_seeds(spark):
    rules = spark.createDataFrame([("allow", "org/")], "verdict string, rule string")
    trust = {}
    for seeds in (0, 50):
        pages = spark.createDataFrame(chain(16, seeds), "page_id long, url string, html string")
        trust[seeds] = {r.host: r.trust for r in u.filter_urls(pages, rules).collect()}
    assert trust[0]["h15.net"] > 0  # 15 links from the seed
    assert abs(trust[0]["h5.net"] - trust[50]["h5.net"]) < 1e-9  # other seeds don't dilute it


def test_tie_of_trust_and_distrust_is_allowed(spark):
    pages = [(1, "http://good.org/", '<a href="http://mid.net/">'), (2, "http://mid.net/", '<a href="http://bad.com/de/">'), (3, "http://bad.com/de/", ""), (4, "http://long.net/", "<p>" * 200_000 + '<a href="http://bad.com/de/">')]
    rules = spark.createDataFrame([("allow", "org/"), ("block", "com/de/")], "verdict string, rule string")
    got = {r.host: (r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in u.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got["long.net"][0] == "block"
    assert got["mid.net"][0] == ("block" if got["mid.net"][2] > got["mid.net"][1] else "allow")
