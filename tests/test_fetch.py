"""HTTP outcomes, redirect chains, robots rules and the politeness schedule against a loop."""

import random
import re
import time

from pyspark.sql import functions as F

from pressroom.operators.fetch import host_rules, next_allowed, path_allowed, requested_hops, resolve_redirects, robots_gate, robots_responses, rule_matches, rule_pieces, schedule_requests
from pressroom.schemas import FETCH_LOG, ROBOTS


def log(spark, rows):
    full = [(url, 0, status, location, kind, length, body, None) for url, status, location, kind, length, body in rows]
    return spark.createDataFrame(full, FETCH_LOG)


HTML = "text/html; charset=utf-8"


def chains(spark, urls, fetched, **options):
    requests = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return resolve_redirects(requests, log(spark, fetched), **options).orderBy("i").collect()


def test_redirects(spark):
    fetched = [
        ("https://a.example/1", 302, "/2", None, None, None),
        ("https://a.example/2", 301, "https://b.example/3#x", None, None, None),
        ("https://b.example/3", 200, None, HTML, None, "<p>x</p>"),
        ("https://a.example/bad", 302, "https://127.0.0.1/secret", None, None, None),
        ("https://127.0.0.1/secret", 200, None, HTML, None, "never read"),
        ("https://a.example/loop", 307, "/loop", None, None, None),
        ("https://a.example/lost", 308, "", None, None, None),
        ("https://a.example/json", 200, None, "application/json", None, "{}"),
        ("https://a.example/big", 200, None, HTML, 6_000_000, None),
        ("https://a.example/down", 503, None, None, None, None),
    ]
    urls = [f"https://a.example/{p}" for p in ("1", "bad", "loop", "lost", "json", "big", "down", "missing")] + ["http://a.example/1"]
    got = [(r.final_url, r.hops, r.outcome, r.error_code, r.retryable) for r in chains(spark, urls, fetched)]
    assert got == [
        ("https://b.example/3", 2, "page", None, False), ("https://127.0.0.1/secret", 1, "error", "unsafe_url", False),
        ("https://a.example/loop", 3, "error", "fetch_failed", False), ("https://a.example/lost", 0, "error", "fetch_failed", False),
        ("https://a.example/json", 0, "error", "fetch_failed", False), ("https://a.example/big", 0, "error", "fetch_failed", False),
        ("https://a.example/down", 0, "error", "fetch_failed", True), ("https://a.example/missing", 0, "error", "fetch_failed", True),
        ("http://a.example/1", 0, "error", "unsafe_url", False),
    ]


def test_body_limit_counts_bytes(spark):
    from pressroom.operators.fetch import classify_fetch

    df = log(spark, [("u", 200, None, HTML, None, "éé"), ("u", 200, None, HTML, None, "ééé")])
    verdict = classify_fetch("status", "location", "content_type", "content_length", F.octet_length("body"), max_bytes=4)
    assert [r.o for r in df.select(verdict["outcome"].alias("o")).collect()] == ["page", "error"]


ROBOTS_ROWS = [
    ("a.example", 200, "User-agent: *\nDisallow: /blocked"),
    ("b.example", 200, "User-agent: news\nUser-agent: x\nDisallow: /\nAllow: /open\nCrawl-delay: 3\n\nUser-agent: *\nDisallow:"),
    ("c.example", 404, None),
    ("d.example", 401, None),
    ("e.example", 500, None),
    ("f.example", 200, "User-agent: *\nDisallow: /a*.pdf$\nDisallow: /p\nAllow: /p\nAllow: /page"),
    ("g.example", 200, "x" * 600_000),
]


def gate(spark, urls, agent="NewsBot/2", **options):
    df = spark.createDataFrame([(i, u, u.split("/")[2]) for i, u in enumerate(urls)], "i int, url string, host string")
    return robots_gate(df, spark.createDataFrame(ROBOTS_ROWS, ROBOTS), agent, **options).orderBy("i").collect()


def test_robots(spark):
    urls = [
        "https://a.example/blocked/x", "https://a.example/ok?u=/blocked", "https://b.example/x", "https://b.example/open", "https://c.example/", "https://d.example/",
        "https://e.example/", "https://f.example/abc.pdf", "https://f.example/abc.pdf?x", "https://f.example/abc.pdfx", "https://f.example/p1", "https://g.example/", "https://h.example/",
    ]
    got = gate(spark, urls)
    assert [r.robots_status for r in got] == [None, "allowed", None, "allowed", "not_found", None, None, None, None, "allowed", "allowed", None, None]
    assert got[11].error_code == "fetch_failed" and got[0].error_code == "robots_denied" and got[3].crawl_delay == 3.0
    opened = gate(spark, urls, fail_closed=False)
    assert [opened[i].robots_status for i in (5, 6, 12)] == [None, "unavailable", "unavailable"]
    assert {r.robots_status for r in gate(spark, urls, respect=False)} == {"disabled"}
    assert [r.robots_status for r in gate(spark, urls[2:4], agent="other")] == ["allowed", "allowed"]


def ruled(spark, rules):
    """One row with the rules (value, allow)."""
    df = spark.createDataFrame(rules, "value string, allow boolean")
    return df.agg(F.collect_list(F.struct(F.length("value").alias("length"), "allow", *rule_pieces(F.col("value")))).alias("rules"))


def test_wildcards_against_patterns(spark):
    rng = random.Random(5)
    draw = lambda letters, n: "/" + "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    values = [draw("ab*", 8) + rng.choice(["", "$", "*", "*$"]) for _ in range(400)] + ["*", "$", "/", "/$", "*$", "/**a$", "a", "/*a*", "/é*b$", "/a$b", "/.*"]
    paths = [draw("ab", 9) for _ in range(60)] + ["/", "/éab", "/a$b", "/.x", ""]
    df = spark.createDataFrame([(v, p) for v in values for p in paths], "value string, path string")
    got = df.withColumn("hit", rule_matches(F.col("path"), F.struct(*rule_pieces(F.col("value")))))
    for r in got.collect():
        pattern = ".*".join(re.escape(x) for x in r.value.removesuffix("$").split("*")) + (r"\Z" if r.value.endswith("$") else "")
        assert r.hit == bool(re.match(pattern, r.path, re.S)), r


def test_wildcards_are_matched_in_one_walk(spark):
    """Ten wildcards against 10,000 long paths that nearly match, and none of them takes long."""
    rules = ruled(spark, [("/" + "a*" * 10 + "b", False), ("/*a*a*a$", False)]).first().rules
    urls = spark.range(10_000).select(F.concat(F.lit("/"), F.repeat(F.lit("a"), 300 + F.col("id").cast("int") % 100), F.lit("c")).alias("path"))
    table = spark.createDataFrame([(rules,)], "rules array<struct<length:int,allow:boolean,head:string,middle:array<string>,tail:string,anchored:boolean>>")
    both = urls.join(F.broadcast(table), F.lit(True))
    start = time.perf_counter()
    assert both.filter(path_allowed("path", "rules")).count() == 10_000
    assert time.perf_counter() - start < 10


def test_longest_rule_wins_and_allow_wins_a_tie(spark):
    rules = [("/ab", True), ("/ab*c", False), ("/xy", False), ("/xy", True)]
    df = ruled(spark, rules)
    row = df.select(*[path_allowed(F.lit(p), "rules") for p in ("/ab", "/abxc", "/xyz", "/none")]).first()
    assert tuple(row) == (True, False, True, True)


def test_robots_are_asked_at_every_hop(spark):
    fetched = [("https://c.example/1", 302, "https://a.example/blocked/x", None, None, None), ("https://a.example/blocked/x", 200, None, HTML, None, "x")]
    rules = host_rules(spark.createDataFrame(ROBOTS_ROWS, ROBOTS), "newsbot")
    row = chains(spark, ["https://c.example/1"], fetched, rules=rules)[0]
    assert (row.hops, row.error_code, row.final_url) == (1, "robots_denied", "https://a.example/blocked/x")


def test_the_latest_capture_counts(spark):
    rows = [("https://m.example/", 0, 500, None, None, None, None, "2024-01-01"), ("https://m.example/", 0, 302, "/new", None, None, None, "2024-01-02"),
            ("https://m.example/new", 0, 200, None, HTML, None, "x", "2024-01-01"), ("https://m.example/new", 0, 200, None, HTML, None, "y", None)]
    kept = spark.createDataFrame(rows, FETCH_LOG.replace("timestamp", "string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = resolve_redirects(spark.createDataFrame([("https://m.example/",)], "url string"), kept).collect()
    assert [(r.final_url, r.hops, r.outcome) for r in got] == [("https://m.example/new", 1, "page")]


def test_redirects_of_robots(spark):
    def at(host):
        return f"https://{host}/robots.txt"

    fetched = [
        (at("moved.example"), 301, "https://www.moved.example/robots.txt", None, None, None),
        (at("www.moved.example"), 200, None, "text/plain", None, "User-agent: *\nDisallow: /private"),
        (at("inner.example"), 302, "https://10.1.2.3/robots.txt", None, None, None),
        (at("round.example"), 302, "/robots.txt", None, None, None),
        (at("odd.example"), 302, "https://[", None, None, None),
        (at("none.example"), 404, None, None, None, None),
    ]
    names = ("moved", "inner", "round", "odd", "none", "silent")
    hosts = spark.createDataFrame([(f"{n}.example",) for n in names] * 2 + [(None,)], "host string")
    answers = robots_responses(hosts, log(spark, fetched))
    assert {r.host.split(".")[0]: r.status for r in answers.collect()} == {
        "moved": 200, "inner": 403, "round": None, "odd": None, "none": 404, "silent": None,
    }
    urls = spark.createDataFrame([(f"https://{n}.example/private/x", f"{n}.example") for n in names], "url string, host string")
    open_ = robots_gate(urls, answers, "newsbot", fail_closed=False).collect()
    assert {r.host.split(".")[0]: r.robots_status for r in open_} == {
        "moved": None, "inner": None, "round": "unavailable", "odd": "unavailable", "none": "not_found", "silent": "unavailable",
    }


def model(rows, free):
    free, out = dict(free), {}
    for i, domain, arrival, delay in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(arrival, free.get(domain, arrival))
        free[domain] = start + delay
        out[i] = (start, start + delay)
    return out, free


def test_schedule_against_a_loop(spark):
    rng = random.Random(2)
    # one domain holds half of all requests, many of which arrive at the same time
    rows = [(i, "hot" if i % 2 else f"d{rng.randint(0, 20)}", rng.randint(0, 300) * 10, rng.choice([0, 5, 40])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, domain string, arrival long, delay long")
    for limits in ({}, {"hot": 1500, "d3": 10**6}):
        expected, free = model(rows, limits)
        table = spark.createDataFrame(list(limits.items()), "domain string, next_allowed long") if limits else None
        for chunks in (1, 6, 40):
            plan = schedule_requests(df, "domain", "arrival", ["i"], "delay", limits=table, chunks=chunks)
            assert {r.i: (r.start_at, r.next_allowed) for r in plan.collect()} == expected
        assert {r.domain: r.next_allowed for r in next_allowed(plan, "domain").collect()} == {k: v for k, v in free.items() if k in {r[1] for r in rows}}


def test_hops_ask_their_own_domains(spark):
    fetched = [
        ("https://a.example/1", 302, "https://b.example/2", None, None, None), ("https://b.example/2", 301, "https://127.0.0.1/", None, None, None),
        ("https://c.example/1", 302, "https://a.example/blocked/x", None, None, None), ("https://a.example/r", 302, "/r", None, None, None),
    ]
    rules = host_rules(spark.createDataFrame(ROBOTS_ROWS, ROBOTS), "newsbot")
    urls = [(i, u) for i, u in enumerate(["https://a.example/1", "https://c.example/1", "https://c.example/1", "http://a.example/", None, "https://a.example/r"])]
    requests = spark.createDataFrame(urls, "i int, url string")
    hops = requested_hops(requests, log(spark, fetched)).collect()
    assert sorted((r.i, r.hop, r.domain) for r in hops) == [
        (0, 0, "a.example"), (0, 1, "b.example"), (1, 0, "c.example"), (1, 1, "a.example"), (2, 0, "c.example"), (2, 1, "a.example"),
        *[(5, n, "a.example") for n in range(4)],
    ]
    ruled_hops = requested_hops(requests, log(spark, fetched), rules=rules).collect()
    assert {(r.i, r.hop) for r in ruled_hops if r.i in (1, 2)} == {(1, 0), (2, 0)}  # the target is denied, so it is not asked
    ends = resolve_redirects(requests, log(spark, fetched)).orderBy("i").collect()
    assert [(r.i, r.hops, r.error_code) for r in ends] == [(0, 2, "unsafe_url"), (1, 1, "fetch_failed"), (2, 1, "fetch_failed"), (3, 0, "unsafe_url"), (4, 0, "unsafe_url"), (5, 3, "fetch_failed")]
