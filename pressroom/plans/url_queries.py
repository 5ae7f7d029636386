"""URL corpus queries over pages, documents, customer and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import page_outline
from ..functions.net import ip_is_public
from ..functions.text import article_gate, clean_text, content_hash, first_nonblank, optional, word_count
from ..functions.urls import is_listing, normalize_url, resolve_url, url_parts
from ..operators.urls import allow_domains, dedupe_first, host_verdicts, host_verdicts_by_table, merge_seen, unseen, valid_scrape_request, validate_urls
from ..sources.intake import explode_batches
from .catalog import case_of, query, table

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(
    """
    SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
           regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
           CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query,
           CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.*)$', 1) END AS fragment
    FROM pages"""
)
def url_parts_of_pages(spark, folder):
    parts = table(spark, folder, "pages").select("page_id", url_parts("url").alias("p"))
    return parts.select("page_id", "p.scheme", "p.host", "p.path", "p.query", "p.fragment")


@query(
    f"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)', 1) || '://' || {_HOST} ||
           CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END ||
           regexp_extract(url, '(\\?[^#]*)', 1) AS normalized_url
    FROM pages"""
)
def url_normalize(spark, folder):
    """Hosts are written in upper case with a closing dot and a default port before they are normalised."""
    url = F.col("url")
    shouted = F.concat(
        F.upper(F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1)),
        F.lit(".:"),
        F.when(url.startswith("https"), "443").otherwise("80"),
        F.regexp_extract(url, "://[^/?#]*(.*)$", 1),
    )
    return table(spark, folder, "pages").select("page_id", normalize_url(shouted).alias("normalized_url"))


@query(
    """
    SELECT page_id, CASE page_id % 14 WHEN 0 THEN 'empty_or_too_long' WHEN 1 THEN 'control_character'
      WHEN 2 THEN 'unparsable' WHEN 3 THEN 'unsupported_scheme' WHEN 4 THEN 'http_not_allowed' WHEN 5 THEN 'credentials'
      WHEN 6 THEN 'bad_hostname' WHEN 7 THEN 'domain_not_allowed' WHEN 8 THEN 'non_default_port' WHEN 9 THEN 'not_public'
      WHEN 10 THEN 'unparsable' WHEN 11 THEN 'empty_or_too_long' END AS reject_reason,
      CASE page_id % 14
        WHEN 12 THEN 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || '/'
        WHEN 13 THEN 'https://xn--bcher-kva.example.com/a%20b%7Cc?q=' || page_id END AS normalized_url
    FROM pages"""
)
def url_reject_reasons(spark, folder):
    """Page URLs spoilt in turn by every way in which a URL is rejected."""
    pages = table(spark, folder, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rest = F.regexp_extract("url", "://[^/?#]*(.*)$", 1)

    def build(prefix: str, suffix: str = ""):
        return F.concat(F.lit(prefix), host, F.lit(suffix), rest)

    spoilt = case_of(
        F.col("page_id"),
        [
            F.lit(""),
            F.concat(F.lit("https://"), host, F.lit("/\t"), rest),
            F.concat(F.lit("//"), host, F.lit(":port"), rest),
            build("ftp://"),
            build("http://"),
            build("https://user:secret@"),
            build("https://under_score."),
            build("https://", ".invalid"),
            build("https://", ":8443"),
            F.concat(F.lit("https://10.1."), F.pmod("page_id", F.lit(250)), F.lit(".7/")),
            build("https://", "/%zz"),
            F.concat(build("https://"), F.repeat(F.lit("x"), 2048)),
            F.concat(F.lit("  HTTPS://"), F.upper(host), F.lit(".:443#top ")),
            F.concat(F.lit("https://Bücher.example.com/a b|c?q="), F.col("page_id")),
        ],
    )
    domains = ["example.com", "example.net", "example.org", "10.1.0.7"]
    domains += [f"10.1.{i}.7" for i in range(250)]
    checked = validate_urls(pages.select("page_id", spoilt.alias("url")), "url", allowed_domains=domains)
    return checked.select("page_id", "reject_reason", "normalized_url")


@query(
    f"""
    WITH h AS (SELECT page_id, {_HOST} AS host, url LIKE 'https:%' AS secure FROM pages),
    d AS (SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', '') AS domain FROM h WHERE secure)
    SELECT page_id, host FROM h
    WHERE EXISTS (SELECT 1 FROM d WHERE h.host = d.domain OR ends_with(h.host, '.' || d.domain))"""
)
def allowlist_semi(spark, folder):
    """Pages on an allow-list table: the parent domains of all https hosts."""
    pages = table(spark, folder, "pages").select("page_id", "url", url_parts("url")["host"].alias("host"))
    domains = pages.filter(F.col("url").startswith("https:")).select(
        F.regexp_replace("host", r"^[^.]*\.", "").alias("domain")
    )
    return allow_domains(pages.drop("url"), "host", domains)


@query(f"SELECT {_HOST} AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def domain_counts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", url_parts("url")["host"].alias("host"))
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


_RANGES = """(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 127 OR (a = 169 AND b = 254)
      OR a = 0 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19))
      OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224)"""


@query(
    f"""
    WITH ips AS (
      SELECT o_custkey, o_orderkey % 256 AS a, (o_orderkey // 256) % 256 AS b, o_custkey % 128 AS c FROM orders)
    SELECT o_custkey AS host, bool_and(NOT {_RANGES}) AS all_public, count(*) AS addresses FROM ips GROUP BY 1"""
)
def ip_public_hosts(spark, folder):
    """One host per customer, one IPv4 address per order; a host is public only if all its addresses are."""
    key = F.col("o_orderkey")
    ip = F.concat_ws(".", key % 256, F.floor(key / 256) % 256, F.col("o_custkey") % 128, F.lit(9))
    dns = table(spark, folder, "orders").select(F.col("o_custkey").alias("host"), ip.alias("ip"))
    sizes = dns.groupBy("host").agg(F.count("*").alias("addresses"))
    return host_verdicts(dns).join(sizes, "host")


@query(
    """
    WITH n AS (SELECT DISTINCT (s_suppkey * 7 % 256 * 16777216 + s_nationkey * 65536 * 9 + s_suppkey * 256) // (1 << (32 - p)) * (1 << (32 - p)) AS low, p
      FROM (SELECT s_suppkey, s_nationkey, 9 + s_suppkey % 18 AS p FROM supplier)),
    ips AS (SELECT DISTINCT o_custkey, (o_orderkey % 256) * 16777216 + (o_orderkey // 256) % 256 * 65536 + o_custkey % 128 * 256 + 9 AS ip FROM orders),
    hit AS (SELECT DISTINCT ip FROM (SELECT DISTINCT ip FROM ips) JOIN n ON ip BETWEEN low AND low + (1 << (32 - p)) - 1)
    SELECT o_custkey AS host, bool_and(hit.ip IS NULL) AS all_public FROM ips LEFT JOIN hit USING (ip) GROUP BY 1"""
)
def networks_from_a_table(spark, folder):
    """Addresses of customers against networks of suppliers, whose lengths go from 9 to 26 bits: the ranges are data."""
    key, supplier = F.col("o_orderkey"), F.col("s_suppkey")
    ip = F.concat_ws(".", key % 256, F.floor(key / 256) % 256, F.col("o_custkey") % 128, F.lit(9))
    dns = table(spark, folder, "orders").select(F.col("o_custkey").alias("host"), ip.alias("ip")).distinct()
    number = supplier * 7 % 256 * 16777216 + F.col("s_nationkey") * 65536 * 9 + supplier * 256
    quad = F.concat_ws(".", *[F.floor(number / 256**i) % 256 for i in (3, 2, 1, 0)])
    networks = table(spark, folder, "supplier").select(F.concat(quad, F.lit("/"), 9 + supplier % 18).alias("network"))
    return host_verdicts_by_table(dns, networks)


@query(
    """
    SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE
      WHEN 4 THEN TRUE WHEN 5 THEN TRUE WHEN 6 THEN FALSE WHEN 7 THEN FALSE END AS public FROM supplier"""
)
def ipv6_public(spark, folder):
    """IPv6 spellings: loopback, private, link-local, documentation, two public ones, an IPv4-mapped private, malformed."""
    key = F.col("s_suppkey")
    tail = F.lower(F.hex(key))
    ip = case_of(
        key,
        [
            F.lit("::1"),
            F.concat(F.lit("fd00::"), tail),
            F.concat(F.lit("FE80::"), tail),
            F.concat(F.lit("2001:db8:0:0:0:0:0:"), tail),
            F.concat(F.lit("2606:4700::"), tail),
            F.concat(F.lit("::ffff:8.8.8."), key % 250),
            F.concat(F.lit("::ffff:10.0.0."), key % 250),
            F.concat(F.lit("2606:4700:::"), tail),
        ],
    )
    return table(spark, folder, "supplier").select("s_suppkey", ip_is_public(ip).alias("public"))


@query(
    """
    SELECT page_id, page_id % 10 IN (0, 1, 2, 3, 4, 5, 6, 7) AS listing FROM pages"""
)
def listing_filter(spark, folder):
    host = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    key = F.col("page_id")
    paths = ["/", "", "/Tag/x", "/tags/x", "/topic/x", "/TOPIK/x", "/searching-x", "/indeks", "/tagged/x", "/en/index"]
    url = F.concat(host, case_of(key, [F.lit(p) for p in paths]), F.lit("?page="), key)
    return table(spark, folder, "pages").select("page_id", is_listing(url).alias("listing"))


@query(
    """
    WITH links AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
    rows AS (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS link FROM links)
    SELECT page_id, link AS link_no,
           regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || replace(replace(url_encode(substr(href, 2)), '%2C', ','), '%2B', '+')
             AS target
    FROM rows"""
)
def resolve_links(spark, folder):
    """Every link of every page as an absolute URL."""
    pages = table(spark, folder, "pages", spread=True)
    outlined = pages.select("page_id", "url", page_outline("html", fields_only=False)["elements"].alias("elements"))
    # elements stand in document order, so a page's links are numbered in its row
    links = F.filter("elements", lambda e: e["tag"] == "a")
    flat = outlined.select("page_id", "url", F.posexplode(F.transform(links, lambda e: F.element_at(e["attrs"], "href"))).alias("link_no", "href"))
    return flat.select("page_id", F.col("link_no").cast("bigint").alias("link_no"), resolve_url("url", "href").alias("target"))


@query(
    """
    SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE page_id % 6
      WHEN 0 THEN '/a/c' WHEN 1 THEN '/x/d' WHEN 2 THEN '/a/b/?n=1' WHEN 3 THEN '/a/b/c?q=1#f' WHEN 4 THEN '/' WHEN 5 THEN '/z/' END
      AS target FROM pages"""
)
def resolve_dot_segments(spark, folder):
    base = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/a/b/c?q=1"))
    refs = ["../c", "/x/./y/../d", "./?n=1", "#f", "../../../..", "/../z/y/.."]
    ref = case_of(F.col("page_id"), [F.lit(r) for r in refs])
    return table(spark, folder, "pages").select("page_id", resolve_url(base, ref).alias("target"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_occurrence(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedupe_first(docs, "text", ["doc_id"])


@query(
    f"""
    WITH h AS (SELECT page_id, {_HOST} AS host, url LIKE 'https:%' AS secure FROM pages)
    SELECT host, min(page_id) AS page_id FROM h
    WHERE secure AND host NOT IN (SELECT host FROM h WHERE NOT secure) GROUP BY host"""
)
def seen_anti_join(spark, folder):
    """First https page of every host that no http page has shown before."""
    pages = table(spark, folder, "pages").select("page_id", "url", url_parts("url")["host"].alias("host"))
    secure = F.col("url").startswith("https:")
    found = dedupe_first(pages.filter(secure).select("page_id", "host"), "host", ["page_id"])
    return unseen(found, pages.filter(~secure), ["host"]).select("host", "page_id")


@query(f"SELECT DISTINCT {_HOST} AS host FROM pages")
def seen_union(spark, folder):
    pages = table(spark, folder, "pages").select("url", url_parts("url")["host"].alias("host"))
    secure = F.col("url").startswith("https:")
    return merge_seen(pages.filter(secure), pages.filter(~secure), ["host"])


_LINES = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents),
    kept AS (SELECT doc_id, len(raw) AS n, list_filter(list_transform(raw, lambda x: trim(x, ' \t\r\f\v' || chr(160))), lambda x: x <> '') AS urls
             FROM lines)"""


@query(
    f"""
    WITH {_LINES}
    SELECT doc_id AS batch_id, unnest(range(len(urls))) AS position, unnest(urls) AS url FROM kept
    WHERE n <= 100 AND len(urls) > 0"""
)
def batch_intake(spark, folder):
    """Every document is a batch, every line an entry."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("batch_id"), F.split("text", "\n").alias("urls"))
    items, _ = explode_batches(docs)
    return items.select("batch_id", F.col("position").cast("bigint").alias("position"), "url")


@query(
    f"""
    WITH {_LINES}
    SELECT doc_id AS batch_id, CASE WHEN n > 100 THEN 'too_many' ELSE 'all_blank' END AS reject_reason FROM kept
    WHERE n > 100 OR len(urls) = 0"""
)
def batch_rejects(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("batch_id"), F.split("text", "\n").alias("urls"))
    return explode_batches(docs)[1]


@query(
    """
    SELECT doc_id, CASE WHEN length(text) < 8 THEN 'too_short' WHEN length(text) > 2048 THEN 'too_long' END AS reject_reason
    FROM documents"""
)
def single_intake(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("url"))
    return valid_scrape_request(docs).select("doc_id", "reject_reason")


_CLEAN = """cleaned AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(regexp_replace(x, '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ' || chr(160) || chr(8195) || chr(12288))), lambda x: x <> ''),
      chr(10) || chr(10)) AS content FROM documents)"""


@query(f"WITH {_CLEAN} SELECT doc_id, content FROM cleaned")
def clean_texts(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", clean_text("text").alias("content"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+'))::INTEGER AS words FROM documents")
def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", word_count("text").alias("words"))


@query(f"WITH {_CLEAN} SELECT doc_id, sha256(content) AS content_hash FROM cleaned")
def content_hashes(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", content_hash(clean_text("text")).alias("content_hash"))


@query(
    f"""
    WITH {_CLEAN}, counted AS (SELECT doc_id, len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+')) AS words FROM cleaned)
    SELECT lang, CASE WHEN words < 80 THEN 'too_short' WHEN lang = 'de' THEN 'no_title' ELSE 'accepted' END AS verdict,
           count(*) AS documents, sum(words)::BIGINT AS words
    FROM counted JOIN documents USING (doc_id) GROUP BY 1, 2"""
)
def word_gate(spark, folder):
    """Quality gate over documents; German ones count as having a blank title."""
    docs = table(spark, folder, "documents", spread=True)
    title = F.when(F.col("lang") == "de", "  ").otherwise(F.col("lang"))
    counted = docs.select("lang", title.alias("title"), word_count(clean_text("text")).alias("words"))
    verdict = F.coalesce(article_gate("words", "title"), F.lit("accepted"))
    return counted.groupBy("lang", verdict.alias("verdict")).agg(
        F.count("*").alias("documents"), F.sum("words").alias("words")
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '' END AS picked,
           CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS kept
    FROM orders"""
)
def optional_fields(spark, folder):
    """First value that is not blank, and '' as NULL."""
    key = F.col("o_orderkey") % 3
    first = F.when(key == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t"))).otherwise(F.lit("  "))
    second = F.when(key < 2, F.col("o_orderstatus")).otherwise("")
    return table(spark, folder, "orders").select(
        "o_orderkey", first_nonblank(first, second).alias("picked"), optional(second).alias("kept")
    )


@query(
    f"""
    SELECT page_id, CASE WHEN url LIKE 'http:%' THEN 'http_not_allowed' WHEN length({_HOST}) % 4 = 0 THEN 'unresolved'
      WHEN length({_HOST}) % 4 = 1 THEN 'not_public' END AS reject_reason
    FROM pages"""
)
def dns_policy(spark, folder):
    """Page URLs against a DNS snapshot of their hosts: not resolved, one address of two private, IPv6, IPv4."""
    pages = table(spark, folder, "pages").select("page_id", "url", url_parts("url")["host"].alias("host"))
    addresses = case_of(
        F.length("host"),
        [
            F.array().cast("array<string>"),
            F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1")),
            F.array(F.lit("2606:4700::6810:84e5")),
            F.array(F.lit("93.184.215.14"), F.lit("93.184.215.15")),
        ],
    )
    dns = pages.select("host").distinct().select("host", F.explode(addresses).alias("ip"))
    return validate_urls(pages.drop("host"), dns=dns, idna=False).select("page_id", "reject_reason")
