import random

from notelake.llm import url_rules as u

SCHEMA = "page_id long, url string, host string, path string, key string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut].translate(str.maketrans(u._UPPER, u._LOWER)), rest[cut:]
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, u.DEFAULT), key=lambda x: x[:2])
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(5)
    hosts = ["example.com", "A.Example.COM", "b.a.example.com", "example.net", "x.net", "org", "notcom", "com", "examplexcom", "", "example.com:80", "é.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/77?x=/de/", "/de/8#a", "/de/9", "/es/1", "/EN/7", "?q=/en/", "#/en/"]
    out = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    out += ["http://com,foo/en/x", "http://org,evil/es/a", "http://foo,com/en/x", "http://a..com/en/", "http://.com/en/"]
    return [*out, None, "", "no scheme", "a://b://c/en/", "http:/x", "x\n://y.com/en/1"]


def check(spark, rules, limit):
    rows = list(enumerate(urls())) + [(0, urls()[0]), (None, urls()[1])]
    pages = spark.createDataFrame([(i, x, "h", "p", "k") for i, x in rows], SCHEMA).repartition(3)
    out = u.judge(pages, u.rule_table(spark, rules), max_swept=limit).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=str) == sorted(((i, *brute(x, rules)) for i, x in rows), key=str)


def test_rules_equal_brute_force_in_both_ways(spark):
    more = [*u.RULES, ("allow", "a.example.com", ""), ("block", "b.a.example.com", "/en/"), ("block", "example.com", ""), ("allow", "com", "/de/"), ("block", "net", "/de/"), ("block", "zz", "/")]
    for rules in (list(u.RULES), more):
        for limit in (u.MAX_SWEPT, 0):
            check(spark, rules, limit)


def test_odd_rules_and_empty_table(spark):
    rules = spark.createDataFrame([("block", None, "/"), ("block", "com", None), ("block", "com", "/x"), ("allow", "com", "/x")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert u.judge(pages, rules).first().verdict == "allow"
    assert u.judge(pages.limit(0), rules).count() == 0 and u.judge(pages, rules.limit(0)).first().rule is None


def test_the_rules_are_those_of_the_contract(spark):
    pages = spark.createDataFrame([(1, "http://a.net/de/1"), (2, "http://www.example.net/de/7"), (3, "http://example.net/de/81"), (4, "http://a.com/en/7"), (5, "http://b.example.com/en/7"), (6, "http://x.org/es/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, u.rule_table(spark), default="none").collect()}
    assert found == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block")}
