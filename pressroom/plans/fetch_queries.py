"""Crawl-log queries: HTTP outcomes, redirect chains, robots rules and the politeness schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators.fetch import (
    classify_fetch,
    next_allowed,
    parse_robots,
    requested_hops,
    resolve_redirects,
    robots_gate,
    robots_responses,
    robots_rules,
    robots_status,
    schedule_requests,
    with_robots_requests,
)
from .catalog import case_of, query, table


@query(
    """
    SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'page' WHEN 1 THEN 'redirect' WHEN 9 THEN 'page' ELSE 'error' END AS outcome,
      CASE WHEN event_id % 10 IN (0, 1, 9) THEN NULL ELSE 'fetch_failed' END AS error_code,
      event_id % 10 IN (3, 8) AS retryable
    FROM events"""
)
def fetch_outcomes(spark, folder):
    """Responses of every kind: page, redirect, lost location, 5xx, 4xx, no HTML, too large twice, no answer, XHTML."""
    key = F.col("event_id")
    statuses = [200, 301, 308, 503, 404, 200, 200, 200, None, 204]
    kinds = ["Text/HTML; charset=utf-8", "", "", "text/html", "text/html", "application/json", "text/html", "text/html", "", "application/xhtml+xml"]
    lengths = [10, None, None, None, None, None, 6_000_000, None, None, None]
    sizes = [10, 0, 0, 0, 0, 10, 10, 6_000_000, None, 10]
    verdict = classify_fetch(
        case_of(key, [F.lit(s).cast("int") for s in statuses]),
        case_of(key, [F.lit("/next" if i == 1 else "") for i in range(10)]),
        case_of(key, [F.lit(k) for k in kinds]),
        case_of(key, [F.lit(n).cast("bigint") for n in lengths]),
        case_of(key, [F.lit(n).cast("bigint") for n in sizes]),
    )
    rows = table(spark, folder, "events").select("event_id", verdict.alias("v"))
    return rows.select("event_id", "v.outcome", "v.error_code", "v.retryable")


@query(
    """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not_found' WHEN 4 THEN 'allowed' END AS closed,
      CASE event_id % 7 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'fetch_failed' ELSE 'robots_denied' END AS closed_error,
      CASE event_id % 7 WHEN 0 THEN 'not_found' WHEN 4 THEN 'allowed' WHEN 1 THEN 'unavailable' WHEN 3 THEN 'unavailable' WHEN 6 THEN 'unavailable' END AS open,
      'disabled' AS ignored
    FROM events"""
)
def robots_statuses(spark, folder):
    """Host-level robots answers with the flag closed, open, and robots ignored."""
    key = F.col("event_id")
    status = case_of(key, [F.lit(s).cast("int") for s in (404, 500, 403, None, 200, 200, 301)])
    size = case_of(key, [F.lit(n) for n in (0, 0, 0, 0, 9, 600_000, 0)])
    closed, opened = robots_status(status, size), robots_status(status, size, fail_closed=False)
    rows = table(spark, folder, "events").select("event_id", closed.alias("c"), opened.alias("o"), robots_status(status, size, respect=False).alias("i"))
    return rows.select(
        "event_id", F.col("c.robots_status").alias("closed"), F.col("c.error_code").alias("closed_error"),
        F.col("o.robots_status").alias("open"), F.col("i.robots_status").alias("ignored"),
    )


def _robots(spark, folder):
    """A robots.txt per page host; what it holds changes with the length of the host name."""
    hosts = table(spark, folder, "pages").select(url_parts("url")["host"].alias("host")).distinct()
    bodies = [
        "User-agent: *\nDisallow: /en/\nAllow: /en/1\nCrawl-delay: 2\n",
        "# nothing for us\nUser-agent: otherbot\nDisallow: /\n",
        "User-Agent: newsbot\nUser-agent: thirdbot\nDisallow: /*.html$\nCrawl-delay: 0.5\n\nUser-agent: *\nDisallow: /\n",
        "user-agent: news\r\ndisallow: /fr\r\nuser-agent: *\r\ndisallow:\r\n",
        "User-agent: *\nDisallow: /*n/*7*\nAllow: /*n/*7*1*\nDisallow: /*/*3*$\nDisallow: /*e*/*4*.*h*t*m*l$\nDisallow: /*a*b*c*d*e*f*g*h*i*j*k$\n",
    ]
    n = F.length("host") % 6
    body = case_of(F.length("host") % 6, [F.lit(b) for b in [*bodies, "no"]])
    return hosts.select("host", F.when(n == 5, 403).otherwise(200).alias("status"), body.alias("body"))


_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


# the lines of the bodies above, by the number of the body
_ROBOTS_LINES = """
    l(k, line, "group", agents, field, value) AS (VALUES
      (0, 1, 1, '*', 'disallow', '/en/'), (0, 2, 1, '*', 'allow', '/en/1'), (0, 3, 1, '*', 'crawl-delay', '2'),
      (1, 2, 1, 'otherbot', 'disallow', '/'),
      (2, 2, 1, 'newsbot,thirdbot', 'disallow', '/*.html$'), (2, 3, 1, 'newsbot,thirdbot', 'crawl-delay', '0.5'), (2, 6, 2, '*', 'disallow', '/'),
      (3, 1, 1, 'news', 'disallow', '/fr'), (3, 3, 2, '*', 'disallow', ''),
      (4, 1, 1, '*', 'disallow', '/*n/*7*'), (4, 2, 1, '*', 'allow', '/*n/*7*1*'), (4, 3, 1, '*', 'disallow', '/*/*3*$'),
      (4, 4, 1, '*', 'disallow', '/*e*/*4*.*h*t*m*l$'), (4, 5, 1, '*', 'disallow', '/*a*b*c*d*e*f*g*h*i*j*k$'))"""

# the group with the longest agent name that ours starts with, '*' last
_ROBOTS_OURS = f"""{_ROBOTS_LINES},
    s AS (SELECT *, list_max(list_transform(string_split(agents, ','),
      lambda a: CASE WHEN a = '*' THEN 0 WHEN a <> '' AND starts_with('newsbot/1.0', a) THEN length(a) ELSE -1 END)) AS score FROM l),
    ours AS (SELECT * FROM s WHERE score >= 0 QUALIFY score = max(score) OVER (PARTITION BY k)),
    delays AS (SELECT k, arg_min(value::DOUBLE, line) AS crawl_delay FROM ours WHERE field = 'crawl-delay' GROUP BY 1)"""


@query(
    f"""
    WITH {_ROBOTS_OURS},
    p AS (SELECT page_id, {_PATH} AS path, length(regexp_extract(url, '://([^/?#]*)', 1)) % 6 AS k FROM pages),
    rules AS (SELECT k, field = 'allow' AS allow, length(value) AS size, '^' || replace(regexp_escape(regexp_replace(value, '\\$$', '')), '\\*', '.*')
      || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS pattern FROM ours WHERE field IN ('allow', 'disallow') AND value <> ''),
    hits AS (SELECT page_id, arg_max(allow, 2 * size + allow::INTEGER) AS allow FROM p JOIN rules USING (k) WHERE regexp_matches(path, pattern) GROUP BY 1),
    d AS (SELECT page_id, k, k = 5 OR NOT coalesce(allow, TRUE) AS denied FROM p LEFT JOIN hits USING (page_id))
    SELECT page_id, CASE WHEN NOT denied THEN 'allowed' END AS robots_status, CASE WHEN denied THEN 'robots_denied' END AS error_code,
      coalesce(crawl_delay, 0) AS crawl_delay
    FROM d LEFT JOIN delays USING (k)"""
)
def robots_gates(spark, folder):
    """Every page URL against its host's rules."""
    pages = table(spark, folder, "pages").select("page_id", "url", url_parts("url")["host"].alias("host"))
    gated = robots_gate(pages, _robots(spark, folder), "NewsBot/1.0")
    return gated.select("page_id", "robots_status", "error_code", "crawl_delay")


_HOST_KINDS = "h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, length(host) % 6 AS k FROM pages)"


@query(f'WITH {_ROBOTS_LINES}, {_HOST_KINDS} SELECT host, "group"::BIGINT AS "group", agents, field, value FROM h JOIN l USING (k)')
def robots_rule_rows(spark, folder):
    rules = parse_robots(_robots(spark, folder))
    return rules.select("host", "group", F.array_join("agents", ",").alias("agents"), "field", "value")


@query(
    f"""
    WITH {_ROBOTS_OURS}, {_HOST_KINDS}
    SELECT host, count(*) FILTER (WHERE field IN ('allow', 'disallow') AND value <> '')::INTEGER AS rules, coalesce(any_value(crawl_delay), 0) AS crawl_delay
    FROM h JOIN ours USING (k) LEFT JOIN delays USING (k) GROUP BY 1"""
)
def robots_agent_rules(spark, folder):
    """The rules that hold for one agent."""
    rules = robots_rules(parse_robots(_robots(spark, folder)), "newsbot")
    return rules.select("host", F.size("rules").alias("rules"), "crawl_delay")


_HOP = "'https://hop.example/' || "


@query(
    f"""
    WITH RECURSIVE log AS (SELECT p_partkey AS k, p_size, CASE WHEN p_size % 4 = 0 THEN p_partkey + 1 WHEN p_size = 1 THEN 0 END AS next FROM part),
    walk AS (SELECT k AS start, k AS here, 0 AS hops FROM log
      UNION ALL SELECT start, next, hops + 1 FROM walk JOIN log ON (k = here) WHERE next IS NOT NULL AND hops < 3),
    ends AS (SELECT start, here, hops FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1)
    SELECT start AS p_partkey, CASE WHEN p_size = 2 AND hops < 3 THEN 'https://127.0.0.1/' || here ELSE {_HOP} here END AS final_url,
      (hops + coalesce(p_size = 2 AND hops < 3, FALSE)::INTEGER)::INTEGER AS hops,
      CASE WHEN k IS NULL OR next IS NOT NULL OR p_size IN (2, 3) THEN 'error' ELSE 'page' END AS outcome,
      CASE WHEN p_size = 2 AND hops < 3 THEN 'unsafe_url' WHEN k IS NULL OR next IS NOT NULL OR p_size IN (2, 3) THEN 'fetch_failed' END AS error_code
    FROM ends LEFT JOIN log ON (k = here)"""
)
def redirect_chains(spark, folder):
    """Parts as URLs: sizes divisible by four redirect to the next part, size 1 all to part 0, size 2 to an unsafe address,
    size 3 answers 404."""
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    url = F.concat(F.lit("https://hop.example/"), key)
    location = (
        F.when(size % 4 == 0, F.concat(F.lit("./"), key + 1, F.lit("#frag")))
        .when(size == 1, "//hop.example/0")
        .when(size == 2, F.concat(F.lit("https://127.0.0.1/"), key))
    )
    log = parts.select(
        url.alias("url"),
        F.when(location.isNotNull(), 302).when(size == 3, 404).otherwise(200).alias("status"),
        location.alias("location"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.lit("<p>x</p>").alias("body"),
    )
    chains = resolve_redirects(parts.select("p_partkey", url.alias("url")), log, idna=False)
    return chains.select("p_partkey", "final_url", "hops", "outcome", "error_code")


@query(
    """
    WITH RECURSIVE log AS (SELECT s_suppkey AS k, s_nationkey % 3 AS kind, CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey + 1 END AS next FROM supplier),
    walk AS (SELECT k AS start, k AS here, 0 AS hops FROM log
      UNION ALL SELECT start, next, hops + 1 FROM walk JOIN log ON (k = here) WHERE next IS NOT NULL AND hops < 3),
    ends AS (SELECT start, here, hops FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1)
    SELECT 's' || start || '.example' AS host, (CASE WHEN kind = 1 THEN 200 WHEN kind = 2 AND k % 2 = 0 THEN 404 WHEN kind = 2 AND hops < 3 THEN 403 END)::INTEGER AS status,
      CASE WHEN kind = 1 THEN 'Disallow: /' || here END AS body FROM ends LEFT JOIN log ON (k = here)"""
)
def robots_redirects(spark, folder):
    """robots.txt of suppliers as hosts: a third redirects to the next supplier, a sixth to an unsafe address, the rest answers; each was
    captured twice, and the older answer does not count."""
    key, kind = F.col("s_suppkey"), F.col("s_nationkey") % 3
    place = F.concat(F.lit("https://s"), key, F.lit(".example/robots.txt"))
    target = F.when(kind == 0, F.concat(F.lit("https://s"), key + 1, F.lit(".example/robots.txt")))
    target = target.when((kind == 2) & (key % 2 == 1), "https://127.0.0.1/robots.txt")
    suppliers = table(spark, folder, "supplier").withColumn("age", F.explode(F.array(F.lit(0), F.lit(1))))
    old = F.col("age") == 1
    log = suppliers.select(
        place.alias("url"),
        F.when(old, 500).when(target.isNotNull(), 301).when(kind == 1, 200).otherwise(404).alias("status"),
        F.when(~old, target).alias("location"),
        F.lit("text/plain").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.concat(F.lit("Disallow: /"), key).alias("body"),
        F.date_sub(F.lit("2024-05-02").cast("date"), F.col("age")).cast("timestamp").alias("fetched_at"),
    )
    hosts = suppliers.select(F.concat(F.lit("s"), key, F.lit(".example")).alias("host"))
    return robots_responses(hosts, log, idna=False)


def _requests(spark, folder):
    """Events as requests: the user is the domain, and every fifth user's domain is slow."""
    delay = F.when(F.col("user_id") % 5 == 0, 10_800_000_000).otherwise(3_600_000_000)
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros("ts").alias("arrival"), delay.cast("bigint").alias("delay")
    )


def _schedule_sql(source: str, order: str, limits: str = "", peak: str = "m") -> str:
    return f"""
    WITH q AS ({source}),
    b AS (SELECT *, coalesce(sum(delay) OVER (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS busy FROM q),
    m AS (SELECT *, max(arrival - busy) OVER (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM b){limits}"""


_REQUESTS = """SELECT event_id, user_id, epoch_us(ts) AS arrival, CASE WHEN user_id % 5 = 0 THEN 10800000000 ELSE 3600000000 END AS delay FROM events"""


@query(_schedule_sql(_REQUESTS, "arrival, event_id") + " SELECT event_id, (busy + m)::BIGINT AS start_at, (busy + m + delay)::BIGINT AS next_allowed FROM m")
def politeness(spark, folder):
    planned = schedule_requests(_requests(spark, folder), "user_id", "arrival", ["event_id"], "delay")
    return planned.select("event_id", "start_at", "next_allowed")


@query(_schedule_sql(_REQUESTS, "arrival, event_id") + " SELECT event_id, (busy + m)::BIGINT AS start_at, (busy + m + delay)::BIGINT AS next_allowed FROM m")
def politeness_in_ranges(spark, folder):
    """The same schedule over more and smaller ranges than tasks."""
    planned = schedule_requests(_requests(spark, folder), "user_id", "arrival", ["event_id"], "delay", chunks=40)
    return planned.select("event_id", "start_at", "next_allowed")


@query(
    _schedule_sql(_REQUESTS, "arrival, event_id")
    + " SELECT user_id, max(greatest(busy + m, busy + epoch_us(TIMESTAMP '2024-01-02')) + delay)::BIGINT AS next_allowed FROM m GROUP BY 1"
)
def politeness_limits(spark, folder):
    """Limits after a schedule that starts from domains blocked until the second of January."""
    requests = _requests(spark, folder)
    blocked = F.unix_micros(F.lit("2024-01-02").cast("timestamp"))
    limits = requests.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", blocked.alias("next_allowed"))
    planned = schedule_requests(requests, "user_id", "arrival", ["event_id"], "delay", limits=limits)
    return next_allowed(planned, "user_id")


_STEPS = """SELECT event_id, user_id, epoch_us(ts) AS arrival, step, CASE step WHEN 0 THEN 1000000 ELSE greatest(1000000, (event_id % 3) * 1500000) END AS delay
    FROM events, (SELECT unnest([0, 1]) AS step)"""


@query(_schedule_sql(_STEPS, "arrival, event_id, step") + " SELECT event_id, step, (busy + m)::BIGINT AS start_at FROM m")
def politeness_with_robots(spark, folder):
    """robots.txt and page requests share their domain's budget."""
    events = table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros("ts").alias("arrival"), ((F.col("event_id") % 3) * 1.5).alias("crawl_delay")
    )
    both = with_robots_requests(events, F.lit(1_000_000).cast("bigint"))
    planned = schedule_requests(both, "user_id", "arrival", ["event_id", "step"], "delay")
    return planned.select("event_id", "step", "start_at")


_HOPS = """WITH RECURSIVE log AS (SELECT p_partkey AS k, p_size % 4 = 0 AS goes FROM part),
    walk AS (SELECT k AS start, k AS here, 0 AS hop FROM log UNION ALL SELECT start, here + 1, hop + 1 FROM walk JOIN log ON (k = here) WHERE goes AND hop < 3)
    SELECT start AS p_partkey, hop, step, 'd' || here % 7 || '.example' AS user_id, start % 100 * 1000000 AS arrival, 1000000 AS delay
    FROM walk, (SELECT unnest([0, 1]) AS step)"""


@query(_schedule_sql(_HOPS, "arrival, p_partkey, hop, step") + " SELECT p_partkey, hop, step, user_id AS domain, (busy + m)::BIGINT AS start_at FROM m")
def politeness_of_hops(spark, folder):
    """Every hop of a redirect chain asks its own domain, for robots.txt and for the page: parts as URLs on seven domains, a quarter of which
    redirect to the next part, and size 1 to an unsafe address, which is never asked."""
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    place = lambda k: F.concat(F.lit("https://d"), k % 7, F.lit(".example/"), k)
    location = F.when(size % 4 == 0, place(key + 1)).when(size == 1, F.concat(F.lit("https://127.0.0.1/"), key))
    log = parts.select(
        place(key).alias("url"),
        F.when(location.isNotNull(), 302).otherwise(200).alias("status"),
        location.alias("location"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.lit("<p>x</p>").alias("body"),
    )
    requests = parts.select("p_partkey", place(key).alias("url"), (key % 100 * 1_000_000).alias("arrival"))
    hops = requested_hops(requests, log, idna=False)
    both = with_robots_requests(hops, F.lit(1_000_000).cast("bigint"))
    planned = schedule_requests(both, "domain", "arrival", ["p_partkey", "hop", "step"], "delay")
    return planned.select("p_partkey", "hop", "step", "domain", "start_at")
