import random

from lexiloom.llm import url_filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, 0, "x") for i, u in enumerate(urls)], "page_id long, url string, part int, host string")
    got = url_filters.match_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_against_brute_force(spark):
    rng = random.Random(7)
    labels = ["com", "net", "example", "example-x", "www", "WWW", "a", "", "é", "x\x00y", "\x01"]
    rules = {(".".join(rng.choice(labels[:8]).lower() for _ in range(rng.randint(1, 4))), rng.choice(["/", "/en/", "/e", "", "/en/a"])) for _ in range(60)}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in sorted(rules)] + RULES
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [rng.choice(["http://", "https://", "x", "://", "a://b://"]) + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/en/a?b#c", "/en", "?/en/", "#x", "/es/://", "/e?f"]) for _ in range(1500)]
    urls += [None, "", "://", "http://", "http://EXAMPLE.com/en/" + "x" * 50_000] + ["https://hot.example.com/en/1"] * 800
    check(spark, urls, rules)
    check(spark, urls, RULES)


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert url_filters.match_rules(pages.limit(0), rules).collect() == []
    assert [(r.rule, r.verdict) for r in url_filters.match_rules(pages, rules.limit(0)).collect()] == [(None, "allow")]
