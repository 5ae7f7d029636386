"""URL policy, normal forms, references, addresses and the skew-safe joins."""

import ipaddress
import random
import time

from pyspark.sql import functions as F

from pressroom.functions.net import SPECIAL_NETWORKS, ip_is_public, ipv6_hex
from pressroom.functions.urls import ascii_host, host_suffixes, is_listing, normalize_url, resolve_url, url_parts
from pressroom.operators.skew import ranked
from pressroom.operators.urls import (
    allow_domains, dedupe_first, host_verdicts_by_table, in_networks, unseen, unseen_in_table, valid_scrape_request, validate_urls, write_seen,
)


def column(spark, values, name="url"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def results(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def dns(spark, *more):
    rows = [("open.site", "1.1.1.1"), ("open.site", "2620:fe::fe"), ("half.site", "9.9.9.9"), ("half.site", "172.20.3.4"), ("xn--caf-dma.site", "1.0.0.1"), *more]
    return spark.createDataFrame(rows, "host string, ip string")


def reasons(spark, urls, **policy):
    return results(validate_urls(column(spark, list(urls)), **policy), "reject_reason")


def test_no_address_of_a_special_network_is_reached(spark):
    networks = [ipaddress.ip_network(n) for n in SPECIAL_NETWORKS]
    inside = [str(n[n.num_addresses // 2]) for n in networks]
    named = [(f"h{i}.site", ip) for i, ip in enumerate(inside)]
    # by name, alone and next to a public address, and as an IPv4 literal
    table = dns(spark, *named, *[(f"two{h}", ip) for h, ip in named], *[(f"two{h}", "1.1.1.1") for h, _ in named])
    assert set(reasons(spark, [f"https://{p}{h}/" for p in ("", "two") for h, _ in named], dns=table)) == {"not_public"}
    literals = [f"https://{ip}/a" for ip in inside if ":" not in ip]
    assert set(reasons(spark, literals)) == {"not_public"}
    assert reasons(spark, ["https://half.site/", "https://open.site/", "https://absent.site/", "https://9.9.9.9/"], dns=table) == ["not_public", None, "unresolved", None]


def test_each_rule_has_its_reason(spark):
    good = "https://open.site/a/b?c=d"
    rules = {
        "empty_or_too_long": ["", good + "/" * 2100, good + "ß" * 1020],
        "control_character": [good + "\t", "\r" + good, good.replace("a", "\x1f")],
        "unparsable": ["open.site/a", "https://", "https:///a", "https://open site/", "https://open.site/%g0", "https://open.site/%f", "https://open.site:1a/"],
        "unsupported_scheme": ["gopher://open.site/", "ws://open.site/"],
        "http_not_allowed": [good.replace("https", "http")],
        "credentials": ["https://me@open.site/", "https://me:word@open.site/", "https://@open.site/"],
        "bad_hostname": ["https://o_pen.site/", "https://open-.site/", "https://op--en.site/", "https://[2620:fe::9]/"],
        "non_default_port": ["https://open.site:80/", "https://open.site:8443/"],
        None: [good, f"  {good} ", "https://open.site:443/", "https://OPEN.site./#part", "https://café.site/menu"],
    }
    cases = [(url, reason) for reason, urls in rules.items() for url in urls]
    assert list(zip([url for url, _ in cases], reasons(spark, [url for url, _ in cases], dns=dns(spark)))) == cases


def test_null_url_is_rejected(spark):
    checked = validate_urls(column(spark, [None]))
    assert results(checked, "reject_reason") == ["empty_or_too_long"]


def test_allow_list_and_normal_form(spark):
    urls = ["https://desk.open.site/p?id=7#end", "https://café.site/menu", "https://open.site.other.site/", "https://notopen.site/", "https://OPEN.site?x"]
    for allowed in (["Open.Site.", " ", "xn--caf-dma.site"], None):
        listed = allowed or spark.createDataFrame([("open.site",), ("xn--caf-dma.site",), ("",)], "domain string")
        checked = validate_urls(column(spark, urls), allowed_domains=listed)
        assert results(checked, "normalized_url") == [
            "https://desk.open.site/p?id=7", "https://xn--caf-dma.site/menu", None, None, "https://open.site/?x",
        ]
        assert results(checked, "reject_reason")[2:4] == ["domain_not_allowed"] * 2


def test_normal_forms(spark):
    cases = {
        "HTTPS://Example.COM.": "https://example.com/",
        "https://example.com/a b|ü": "https://example.com/a%20b%7C%C3%BC",
        "https://example.com/a!b(c)*": "https://example.com/a!b(c)*",
        "https://example.com/a!b c*+": "https://example.com/a%21b%20c%2A+",
        "https://example.com/%2Fx/%7e": "https://example.com/%2Fx/%7e",
        "https://example.com/?": "https://example.com/?",
        "https://example.com/??a b": "https://example.com/??a b",
        "https://example.com#frag": "https://example.com/",
    }
    df = column(spark, cases).withColumn("n", normalize_url("url"))
    assert dict(zip(cases, results(df, "n"))) == cases


def test_parts_of_hosts_that_java_refuses(spark):
    df = column(spark, ["https://bücher.example/a|b", "https://a_b.example/?"]).withColumn("p", url_parts("url"))
    assert [p["host"] for p in results(df, "p")] == ["bücher.example", "a_b.example"]
    assert [p["query"] for p in results(df, "p")] == [None, ""]


def test_references(spark):
    base = "https://n.example/a/b/c?q=1#f"
    cases = {
        "d": "https://n.example/a/b/d", "./d": "https://n.example/a/b/d", "../d": "https://n.example/a/d", "../../../d": "https://n.example/d",
        "/d": "https://n.example/d", "//o.example/d": "https://o.example/d", "https://o.example": "https://o.example", "?x": "https://n.example/a/b/c?x",
        "#g": "https://n.example/a/b/c?q=1#g", "": "https://n.example/a/b/c?q=1#f", "..": "https://n.example/a/", ".": "https://n.example/a/b/",
        "a:b/c": "a:b/c", "1:b/c": base, "/%zz": base, "/image.jpg": "https://n.example/image.jpg", "mailto:x@y": "mailto:x@y", "/a b": "https://n.example/a%20b",
        "http://o.example/x/../y": "http://o.example/y",
    }
    df = column(spark, cases, "ref").withColumn("t", resolve_url(F.lit(base), "ref"))
    assert dict(zip(cases, results(df, "t"))) == cases


def test_listing_pages(spark):
    cases = {"/": True, "": True, "/TAG/x": True, "/tag": False, "/searching-x": True, "/indeks-berita": True, "/a/tag/x": False, "/topik/": True}
    df = column(spark, [f"https://n.example{path}" for path in cases]).withColumn("l", is_listing("url"))
    assert results(df, "l") == list(cases.values())


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(7)
    special = [ipaddress.ip_network(n) for n in SPECIAL_NETWORKS]
    v4 = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(300)]
    v6 = [ipaddress.ip_address(rng.getrandbits(128)) for _ in range(200)]
    edges = [a for n in special for a in (n[0], n[-1])] + [n[0] + n.num_addresses for n in special if int(n[-1]) + 1 < 2**n.max_prefixlen]
    texts = [str(a) for a in v4 + v6 + edges] + [a.exploded for a in v6]

    def public(text):
        ip = ipaddress.ip_address(text)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not any(ip in n for n in special if n.version == ip.version)

    df = column(spark, texts, "ip").withColumn("p", ip_is_public("ip"))
    assert results(df, "p") == [public(t) for t in texts]
    six = [t for t in texts if ":" in t]
    hexed = column(spark, six, "ip").withColumn("h", ipv6_hex("ip"))
    assert results(hexed, "h") == [f"{int(ipaddress.ip_address(t)):032x}" for t in six]
    bad = column(spark, ["1.2.3", "1.2.3.256", "::g", "1::2::3", ":::", "1:2:3:4:5:6:7", "x", "::ffff:10.0.0.1", "::ffff:1.2.3.4.5"], "ip")
    assert results(bad.withColumn("p", ip_is_public("ip")), "p") == [False] * 9


def test_suffixes(spark):
    df = column(spark, ["a.b.c"], "h").withColumn("s", host_suffixes("h"))
    assert results(df, "s") == [["a.b.c", "b.c", "c"]]


def test_single_intake_counts_before_trimming(spark):
    df = valid_scrape_request(column(spark, ["short", "   abc   ", "x" * 2048, "é" * 2049]))
    assert results(df, "reject_reason") == ["too_short", None, None, "too_long"]
    assert results(df, "url")[1] == "abc"


def test_first_occurrence_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 < 2, "same").otherwise(F.col("id").cast("string")).alias("url"))
    first = dedupe_first(df, "url", ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(r.id for r in first.collect()) == [0, *range(2, 1000, 3)]


def test_unseen_and_allow_list_rows(spark):
    df = spark.createDataFrame([("a.x.com", 1), ("x.com", 2), ("ax.com", 3), ("x.com", 4)], "host string, i int")
    kept = allow_domains(df, "host", spark.createDataFrame([("X.com.",)], "domain string"))
    assert sorted(r.i for r in kept.collect()) == [1, 2, 4]
    assert [r.i for r in unseen(df, spark.createDataFrame([("x.com",)], "host string"), ["host"]).orderBy("i").collect()] == [1, 3]


def test_rank_over_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 501).alias("v"))
    rows = ranked(df, ["v"], "r", chunks=7).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.r)] == sorted(r.v for r in rows)
    assert sorted(r.r for r in rows) == list(range(1, 501))


def test_native_functions_have_no_python_stage(spark):
    df = column(spark, ["https://a.example/x"])
    for plan_of in (
        df.select(normalize_url("url"), is_listing("url"), resolve_url("url", F.lit("../x")), ip_is_public("url")),
        validate_urls(df, idna=False, dns=dns(spark)),
    ):
        plan = plan_of._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Cartesian" not in plan


def test_hostile_urls_are_refused_in_no_time(spark):
    """Many labels, no limit on length, long runs: nothing here may recurse per label or look back over what it has read."""
    urls = [
        "https://" + "a." * 900 + "com/", "https://" + "a." * 200_000 + "com/", "https://" + "a-" * 900 + "/", "https://" + "a" * 1900 + "/",
        "https://x.example/" + "%2" * 900, "https://x.example/" + "é" * 800, "h" * 500_000, "https://" + "@" * 1900, "https://x.example/?" + "a" * 1900,
    ]
    df = column(spark, urls)
    validate_urls(column(spark, ["https://warm.example/"])).collect()
    start = time.perf_counter()
    got = results(validate_urls(df, allowed_domains=["example"]), "reject_reason")
    assert time.perf_counter() - start < 5
    assert got == ["domain_not_allowed", "empty_or_too_long", "bad_hostname", "domain_not_allowed", "unparsable", None, "empty_or_too_long", "unparsable", None]
    hosts = ["a..b", "a.b.", "a.b..", "-a.b", "a-.b", "ab--c.d", "xn--c.d", "A_b.c", "", ".", "a", "é.f"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    assert results(df.withColumn("h", ascii_host(F.col("host"))), "h") == ["a..b", "a.b", None, None, None, None, "xn--c.d", None, None, None, "a", None]


def test_networks_as_a_table(spark):
    rng = random.Random(9)
    networks = [f"{ipaddress.ip_address(rng.getrandbits(32))}/{rng.randint(0, 32)}" for _ in range(60)]
    networks += [f"{ipaddress.ip_address(rng.getrandbits(128))}/{rng.randint(0, 128)}" for _ in range(60)]
    networks = [n for n in networks if int(n.split("/")[1]) > 2] + ["10.1.2.3", "::1", "2001:db8::/33"]
    ips = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(100)]
    ips += ["10.1.2.3", "10.1.2.4", "::1", "::2", "2001:db8:7fff::1", "2001:db8:8000::1", "::ffff:10.1.2.3"]
    for text in networks[:100]:  # both ends of a network, and their neighbours
        net = ipaddress.ip_network(text, strict=False)
        low, high = int(net.network_address), int(net.broadcast_address)
        top = 2 ** (32 if net.version == 4 else 128) - 1
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        ips += [str(kind(n)) for n in (low, high, max(low - 1, 0), min(high + 1, top))]
    bad = ["10.0.0.0/33", "x/8", "10.0.0.0/8/8", "::/129", "10.0.0.0/", None]
    table = spark.createDataFrame([(n,) for n in networks + bad], "network string")
    got = {tuple(r) for r in in_networks(spark.createDataFrame([(i,) for i in [*ips, "no address", None]], "ip string"), table).collect()}

    def wide(address):
        return int(address) + (0xFFFF << 32) if address.version == 4 else int(address)

    expected = set()
    for text in networks:
        net = ipaddress.ip_network(text, strict=False)
        low, high = wide(net.network_address), wide(net.broadcast_address)
        expected |= {(i, text) for i in ips if low <= wide(ipaddress.ip_address(i)) <= high}
    assert got == expected
    dns_rows = spark.createDataFrame([("a", "10.1.2.3"), ("a", "9.9.9.9"), ("b", "9.9.9.9"), ("c", "oops")], "host string, ip string")
    few = spark.createDataFrame([("10.0.0.0/8",)], "network string")
    assert {tuple(r) for r in host_verdicts_by_table(dns_rows, few).collect()} == {("a", False), ("b", True), ("c", False)}


def test_the_seen_side_is_not_shuffled(spark, tmp_path):
    seen = spark.range(5000).select(F.concat(F.lit("u"), F.col("id")).alias("url"))
    write_seen(seen.unionByName(seen), "pressroom_seen_test", ["url"], 8, str(tmp_path / "seen"))
    try:
        new = spark.range(4900, 5100).select(F.concat(F.lit("u"), F.col("id")).alias("url"), "id")
        left = unseen_in_table(new, "pressroom_seen_test", ["url"])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(r.id for r in left.collect()) == list(range(5000, 5100))
    finally:
        spark.sql("DROP TABLE pressroom_seen_test")
