"""Robots rules: parsing, statuses, and decisions against a plain search over all rules."""

import random
import re

from corpusloom.sources import robots

BODY = """# hello
User-agent: *
Disallow: /private # not for all
Allow: /private/open
Disallow: /*.pdf$
Disallow:

User-agent: Loom
User-agent: Other
Disallow: /a*b
Sitemap: http://x.org/map
nonsense
user-agent: empty
"""


def test_parsing(spark):
    got = {(r.agent, r.allow, r.path) for r in robots.parse_rules(spark.createDataFrame([("x.org", BODY), ("y.org", None)], "domain string, body string")).collect()}
    assert got == {("*", True, ""), ("*", False, "/private"), ("*", True, "/private/open"), ("*", False, "/*.pdf$"), ("loom", True, ""), ("other", True, ""), ("loom", False, "/a*b"), ("other", False, "/a*b"), ("empty", True, "")}


def decided(spark, urls, statuses, bodies, agent):
    sites = spark.createDataFrame(statuses, "domain string, status int")
    rules = robots.parse_rules(spark.createDataFrame(bodies, "domain string, body string"))
    return {r.url: (r.allowed, r.reason) for r in robots.decide(spark.createDataFrame([(u,) for u in urls], "url string"), sites, rules, user_agent=agent).collect()}


def test_rules_and_statuses(spark):
    urls = ["http://x.org/private/1", "http://x.org/private/open/2#top", "http://X.org/z/a.pdf", "http://x.org/z/a.pdf?q", "http://x.org", "http://gone.org/x", "http://shut.org/x", "http://down.org/", "http://nowhere.org/", None, "http://x.org/private/1"]
    statuses = [("x.org", 200), ("gone.org", 404), ("shut.org", 403), ("down.org", None)]
    got = decided(spark, urls, statuses, [("x.org", BODY)], "Somebody/1.0")
    assert got == {
        urls[0]: (False, "disallowed"), urls[1]: (True, "allowed"), urls[2]: (False, "disallowed"), urls[3]: (True, "allowed"), urls[4]: (True, "allowed"),
        urls[5]: (True, "absent"), urls[6]: (False, "unavailable"), urls[7]: (False, "unavailable"), urls[8]: (False, "unavailable")}
    named = decided(spark, ["http://x.org/private/1", "http://x.org/a1b2", "http://x.org/ab", "http://x.org/ba"], statuses, [("x.org", BODY)], "Corpusloom bot")
    assert [named[u][0] for u in sorted(named)] == [False, False, True, True]
    assert decided(spark, ["http://x.org/private/1"], statuses, [("x.org", BODY)], "empty") == {"http://x.org/private/1": (True, "allowed")}
    assert decided(spark, ["http://x.org/private/1"], statuses, [], "any") == {"http://x.org/private/1": (True, "allowed")}


def test_random_rules_against_all(spark):
    rng = random.Random(9)
    part = lambda n, more="": "".join(rng.choice("/ab.?(" + more) for _ in range(n))
    rules = {d: [(rng.random() < 0.5, "/" + part(rng.randint(0, 4), "*") + rng.choice(["", "", "$"])) for _ in range(12)] for d in ("p.org", "q.org")}
    urls = [f"http://{rng.choice(['p.org', 'q.org'])}/{part(rng.randint(0, 7))}" for _ in range(300)]
    bodies = [(d, "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in own)) for d, own in rules.items()]
    got = decided(spark, urls, [("p.org", 200), ("q.org", 200)], bodies, "x")
    for u in set(urls):
        domain, path = re.fullmatch(r"http://([^/]*)(/.*)", u).groups()
        hits = []
        for allow, p in rules[domain]:
            form = "".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + ("$" if p.endswith("$") else "")
            if re.match(form, path):
                hits.append((len(p), allow))
        assert got[u][0] == max(hits, default=(0, True))[1], (u, hits)
