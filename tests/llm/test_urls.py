import random

from oracle_check import compare, oracle_connection
from soundfield.llm import urls
from soundfield.llm.queries import ORACLES, QUERIES


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0] or [len(tail)])]
    fit = [(len(h + (p or "")), v, h + (p or "")) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=(0, default, None))
    return host, path, best[2], best[1]


def test_random_rules_against_brute_force(spark):
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "ab", "É", ""])
    name = lambda n: ".".join(label() for _ in range(n))
    tail = lambda: "".join(rng.choices("/xyZ-", k=rng.randrange(0, 6)))
    rules = [(name(rng.randrange(1, 4)), rng.choice(["", "/"]) + tail(), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [(None, "/", "block"), ("", "/", "block"), ("a", None, "block")]
    rows = [(i, rng.choice(["http://", "x://", "", "://"]) + name(rng.randrange(1, 5)).upper() + rng.choice(["", "/", "?", "#"]) + tail() + rng.choice(["", "?q", "#/x"])) for i in range(700)]
    rows += [(None, None), (1, "http://a/x"), (1, "http://a/x")] + [(900 + i, "http://hot.a.b/xy") for i in range(300)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(4), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = sorted([(i, *brute(u, rules)) for i, u in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "k", 2)], "page_id long, url string, key string, id int")
    rules = spark.createDataFrame([("b", "/", "block", 1)], "host string, path string, verdict string, id int")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert urls.judge(pages, rules.limit(0)).collect()[0].verdict == "allow"
    assert urls.judge(pages, rules).collect()[0].rule == "b/"


def test_query_equals_oracle(spark, small):
    ok, message = compare(spark, oracle_connection(small), "op6_urls", QUERIES["op6_urls"], ORACLES["op6_urls"], small)
    assert ok, message
