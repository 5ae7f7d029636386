"""Crawl-log operators: HTTP outcome, redirect chains, robots rules and the politeness schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, let
from ..functions.urls import resolve_url, url_parts
from .skew import durable, first_per_key, ordered_chunks
from .urls import validate_urls

# Limits and status sets of the crawler.
REDIRECTS = (301, 302, 303, 307, 308)
MAX_PAGE_BYTES = 5 * 1024 * 1024
MAX_ROBOTS_BYTES = 512 * 1024
MAX_REDIRECTS = 3

# the detail of a redirect whose target cannot be read as a URL
NO_TARGET = "redirect target is not a URL"

OUTCOME = "struct<outcome:string,error_code:string,error_detail:string,retryable:boolean>"


def _outcome(
    outcome: str, code: Column | str | None = None, detail: Column | str | None = None, retryable: Column | bool = False
) -> Column:
    code = F.lit(code) if code is None or isinstance(code, str) else code
    detail = F.lit(detail) if detail is None or isinstance(detail, str) else detail
    retryable = F.lit(retryable) if isinstance(retryable, bool) else retryable
    return F.struct(
        F.lit(outcome).alias("outcome"),
        code.cast("string").alias("error_code"),
        detail.cast("string").alias("error_detail"),
        retryable.alias("retryable"),
    )


def is_redirect(status: Column | str) -> Column:
    return col(status).isin(*REDIRECTS)


def classify_fetch(
    status: Column | str,
    location: Column | str,
    content_type: Column | str,
    content_length: Column | str,
    body_bytes: Column | str,
    max_bytes: int = MAX_PAGE_BYTES,
) -> Column:
    """Outcome struct of one response: ``page``, ``redirect`` or ``error``. A NULL status is a failed connection."""
    status, location, kind = col(status), col(location), F.lower(F.coalesce(col(content_type), F.lit("")))
    too_large = _outcome("error", "fetch_failed", "response exceeds the size limit")
    return (
        F.when(status.isNull(), _outcome("error", "fetch_failed", "page could not be fetched", True))
        .when(F.coalesce(col(content_length) > max_bytes, F.lit(False)), too_large)
        .when(
            is_redirect(status),
            F.when(
                F.coalesce(location, F.lit("")) == "", _outcome("error", "fetch_failed", "redirect without a location")
            ).otherwise(_outcome("redirect")),
        )
        .when(
            ~status.between(200, 299),
            _outcome("error", "fetch_failed", F.concat(F.lit("page returned HTTP "), status.cast("string")), status >= 500),
        )
        .when(
            ~(kind.contains("text/html") | kind.contains("application/xhtml+xml")),
            _outcome("error", "fetch_failed", "no HTML document"),
        )
        .when(F.coalesce(col(body_bytes) > max_bytes, F.lit(False)), too_large)
        .otherwise(_outcome("page"))
    )


def _nodes(requests: DataFrame, fetch_log: DataFrame, rules: DataFrame | None, policy: dict) -> DataFrame:
    """What happens at each distinct URL that is asked for or that some response of the log leads to, materialised once.

    (_current, _at, host, robots_status, crawl_delay, _asked, _state, _next): ``_state`` is the outcome there, ``_next`` where a redirect goes on, ``_asked`` whether a request
    is made at all. Nothing here depends on how a chain came to the URL.
    """
    captured = F.col("fetched_at") if "fetched_at" in fetch_log.columns else F.lit(None).cast("timestamp")
    log = fetch_log.select(
        captured.alias("_captured"),
        F.col("url").alias("_at"),
        F.col("location").alias("_location"),
        classify_fetch("status", "location", "content_type", "content_length", F.octet_length("body")).alias("_response"),
    )
    latest = [F.col("_captured").desc_nulls_last(), F.struct("_location", "_response")]
    redirect = F.col("_response.outcome") == "redirect"
    log = first_per_key(log, ["_at"], latest).select(
        "_at", "_response", F.when(redirect & url_parts("_location").isNotNull(), resolve_url("_at", "_location")).alias("_next")
    )
    starts = requests.select(F.col("url").alias("_current"))
    urls = starts.unionByName(log.filter("_next IS NOT NULL").select(F.col("_next").alias("_current"))).distinct()
    checked = validate_urls(urls, "_current", **policy).withColumnRenamed("normalized_url", "_at")
    if rules is None:
        no_rule = {"robots_status": F.lit("unknown"), "crawl_delay": F.lit(0.0)}
        no_rule |= {name: F.lit(None).cast("string") for name in ("error_code", "error_detail")}
        checked = checked.withColumns(no_rule)
    else:
        checked = apply_rules(checked, rules, url="_at")
    found = F.col("_response")
    state = (
        F.when(F.col("reject_reason").isNotNull(), _outcome("error", "unsafe_url", F.col("reject_reason")))
        .when(F.col("error_code").isNotNull(), _outcome("error", F.col("error_code"), F.col("error_detail")))
        .when(found.isNull(), _outcome("error", "fetch_failed", "page could not be fetched", True))
        .otherwise(found)
    )
    asked = F.col("reject_reason").isNull() & F.col("error_code").isNull()
    joined = checked.join(log, "_at", "left")
    return durable(joined.select("_current", "_at", "host", "robots_status", "crawl_delay", asked.alias("_asked"), state.alias("_state"), "_next"))


def _walks(requests: DataFrame, nodes: DataFrame, max_redirects: int) -> list[DataFrame]:
    """Per hop the nodes that chains from the distinct requested URLs (``_start``) are at. A hop starts from the redirects of the one before only."""
    at = nodes.join(requests.select(F.col("url").alias("_start")).distinct(), F.col("_current").eqNullSafe(F.col("_start")))
    out = [at]
    for _ in range(max_redirects):
        going = at.filter("_state.outcome = 'redirect' AND _next IS NOT NULL").select("_start", F.col("_next").alias("_current"))
        at = going.join(nodes, "_current").select(*nodes.columns, "_start")
        out.append(at)
    return out


def resolve_redirects(
    requests: DataFrame,
    fetch_log: DataFrame,
    max_redirects: int = MAX_REDIRECTS,
    rules: DataFrame | None = None,
    **policy,
) -> DataFrame:
    """Follow every request (column ``url``) through the fetch log; of repeated captures of a ``url`` the latest counts.

    Each distinct URL is validated, and tested against robots ``rules`` (see :func:`host_rules`) when they are given, before its response is
    looked at: an unsafe or denied target ends the chain unread. That is done once per URL, whatever the number of chains through it, and materialised; then the distinct
    chains walk from redirect to redirect, one join per hop over those still going, and the requests get their chain's end by one join. Bodies stay in
    the log. Adds ``final_url``, ``hops``, ``robots_status`` and the outcome columns.
    """
    nodes = _nodes(requests, fetch_log, rules, policy)
    redirect = F.col("_state.outcome") == "redirect"
    ends = None
    for hop, at in enumerate(_walks(requests, nodes, max_redirects)):
        last = hop == max_redirects
        state = F.when(
            redirect, _outcome("error", "fetch_failed", "too many redirects") if last else _outcome("error", "unsafe_url", NO_TARGET)
        ).otherwise(F.col("_state"))
        here = at.filter(F.lit(last) | ~redirect | F.col("_next").isNull()).select(
            "_start", F.coalesce("_at", "_current").alias("final_url"), F.lit(hop).alias("hops"), "robots_status", state.alias("_end")
        )
        ends = here if ends is None else ends.unionByName(here)
    joined = requests.join(ends, requests["url"].eqNullSafe(ends["_start"]))
    return joined.select(*[requests[c] for c in requests.columns], "final_url", "hops", "robots_status", "_end.*")


def requested_hops(
    requests: DataFrame,
    fetch_log: DataFrame,
    max_redirects: int = MAX_REDIRECTS,
    rules: DataFrame | None = None,
    **policy,
) -> DataFrame:
    """A row per URL that is asked for on the way of each request: its columns, ``hop`` from 0, ``hop_url``, ``domain`` and ``crawl_delay``.

    Unsafe and denied targets are not asked for. This is what a politeness schedule has to make room for: a redirect's target is a request to its
    own domain, see :func:`with_robots_requests`.
    """
    nodes = _nodes(requests, fetch_log, rules, policy)
    hops = None
    for hop, at in enumerate(_walks(requests, nodes, max_redirects)):
        here = at.filter("_asked").select("_start", F.lit(hop).alias("hop"), F.col("_at").alias("hop_url"), F.col("host").alias("domain"), "crawl_delay")
        hops = here if hops is None else hops.unionByName(here)
    joined = requests.join(hops, requests["url"].eqNullSafe(hops["_start"]))
    return joined.select(*[requests[c] for c in requests.columns], "hop", "hop_url", "domain", "crawl_delay")


def robots_status(
    status: Column | str, body_bytes: Column | str, respect: bool = True, fail_closed: bool = True
) -> Column:
    """STRUCT(robots_status, denied, error_detail): what a robots.txt response says about a host as a whole.

    ``allowed`` means that the host's rules decide. A NULL status is a failed connection.
    """
    status = col(status)

    def verdict(name: str | None, detail: str | None = None, code: str | None = None) -> Column:
        return F.struct(
            F.lit(name).cast("string").alias("robots_status"),
            F.lit(code).cast("string").alias("error_code"),
            F.lit(detail).cast("string").alias("error_detail"),
        )

    def unavailable(detail: str) -> Column:
        return verdict(None, detail, "robots_denied") if fail_closed else verdict("unavailable")

    if not respect:
        return verdict("disabled")
    return (
        F.when(status.isNull() | is_redirect(status), unavailable("robots.txt cannot be checked"))
        .when(status == 404, verdict("not_found"))
        .when(status.isin(401, 403), verdict(None, "robots.txt denies the crawler", "robots_denied"))
        .when(~status.between(200, 299), unavailable("robots.txt returned an error"))
        .when(
            F.coalesce(col(body_bytes) > MAX_ROBOTS_BYTES, F.lit(False)),
            verdict(None, "response exceeds the size limit", "fetch_failed"),
        )
        .otherwise(verdict("allowed"))
    )


def parse_robots(df: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """robots.txt bodies → one row per rule (host, group, agents, line, field, value).

    Consecutive ``User-agent`` lines share a group. All windows run inside one body, which the size limit bounds.
    """
    lines = df.select(
        host, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("line", "_text")
    ).withColumn("_text", F.regexp_replace("_text", "#.*$", ""))
    fields = lines.select(
        host,
        "line",
        F.lower(F.trim(F.substring_index("_text", ":", 1))).alias("field"),
        F.trim(F.regexp_replace("_text", "^[^:]*:?", "")).alias("value"),
    ).filter(F.col("field").isin("user-agent", "disallow", "allow", "crawl-delay"))
    order = Window.partitionBy(host).orderBy("line")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = fields.withColumn("group", F.sum(opens.cast("int")).over(order)).filter("group > 0")
    member = Window.partitionBy(host, "group")
    agents = F.array_sort(F.collect_set(F.when(F.col("field") == "user-agent", F.lower("value"))).over(member))
    return grouped.withColumn("agents", agents).filter("field != 'user-agent'")


def robots_rules(rules: DataFrame, agent: str, host: str = "host") -> DataFrame:
    """One row per host with the rules that hold for the agent (``rules`` array, ``crawl_delay`` seconds).

    The group with the longest agent name that ours starts with wins, ``*`` comes last. The size limit on the body
    bounds the array.
    """
    ours = F.lit(agent.lower())
    best = F.array_max(
        F.transform("agents", lambda a: F.when(a == "*", 0).when((a != "") & F.startswith(ours, a), F.length(a)).otherwise(-1))
    )
    scored = rules.withColumn("_score", best).filter("_score >= 0")
    top = scored.groupBy(host).agg(F.max("_score").alias("_score"))
    chosen = scored.join(top, [host, "_score"], "left_semi")
    rule = F.when(
        F.col("field").isin("allow", "disallow") & (F.col("value") != ""),
        F.struct(
            F.length("value").alias("length"), (F.col("field") == "allow").alias("allow"), *rule_pieces(F.col("value"))
        ),
    )
    delay = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    return chosen.groupBy(host).agg(
        F.collect_list(rule).alias("rules"), F.coalesce(F.min_by(delay, F.when(delay.isNotNull(), F.col("line"))), F.lit(0.0)).alias("crawl_delay")
    )


def rule_pieces(value: Column) -> tuple[Column, Column, Column, Column]:
    """A rule as its text before the first ``*`` (``head``), the texts between (``middle``), the one after the last (``tail``; NULL without a ``*``), and
    whether a ``$`` ends it (``anchored``)."""
    anchored = value.endswith("$")
    pieces = F.split(F.when(anchored, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value), r"\*")
    n = F.size(pieces)
    return (
        F.get(pieces, F.lit(0)).alias("head"),
        F.when(n > 2, F.filter(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), lambda p: p != "")).alias("middle"),
        F.when(n > 1, F.get(pieces, n - 1)).alias("tail"),
        anchored.alias("anchored"),
    )


def rule_matches(path: Column, rule: Column) -> Column:
    """Does the rule hold for the path? Each text between wildcards is taken at its first place after the one before, which leaves the most to the
    next: one walk along the path, whatever the wildcards."""
    head, tail, anchored = rule["head"], rule["tail"], rule["anchored"]

    def after(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, path, at)
        return F.when((at > 0) & (found > 0), found + F.length(piece)).otherwise(F.lit(0))

    def ends(at: Column) -> Column:
        last = F.endswith(path, tail) & (F.length(path) - F.length(tail) + 1 >= at)
        return (at > 0) & F.when(anchored, last).otherwise((tail == "") | (F.call_function("locate", tail, path, at) > 0))

    middle = F.coalesce(rule["middle"], F.array().cast("array<string>"))
    wild = let(F.aggregate(middle, F.length(head) + 1, after), ends)
    return F.startswith(path, head) & F.when(tail.isNull(), ~anchored | (path == head)).otherwise(wild)


def path_allowed(path: Column | str, rules: Column | str) -> Column:
    """The longest matching rule decides, an allow rule wins a tie, no match allows. The query is not looked at."""
    path = col(path)
    hits = F.filter(col(rules), lambda r: rule_matches(path, r))
    return F.coalesce(F.array_max(F.transform(hits, lambda r: F.struct(r["length"], r["allow"])))["allow"], F.lit(True))


def robots_responses(hosts: DataFrame, fetch_log: DataFrame, max_redirects: int = MAX_REDIRECTS, **policy) -> DataFrame:
    """(host, status, body): the answer of each distinct host for its robots.txt, redirects followed through the fetch log.

    Every hop is validated before it is read. A redirect to an unsafe address counts as a refusal (403), whatever the
    setting for unreachable hosts; a chain that breaks or is too long has no status, like a failed connection.
    """
    sites = hosts.select(F.col("host").alias("_site")).filter("_site IS NOT NULL").distinct()
    asked = sites.withColumn("url", F.concat(F.lit("https://"), F.col("_site"), F.lit("/robots.txt")))
    chains = resolve_redirects(asked, fetch_log, max_redirects, **policy)
    captured = F.col("fetched_at") if "fetched_at" in fetch_log.columns else F.lit(None).cast("timestamp")
    answers = fetch_log.filter(F.col("url").endswith("/robots.txt") | F.col("status").isNotNull()).select(
        F.col("url").alias("final_url"), "status", "body", captured.alias("_captured")
    )
    # only the answers at the ends of chains are read on, before the latest of each is chosen
    answers = answers.join(chains.select("final_url").distinct(), "final_url", "left_semi")
    answers = first_per_key(answers, ["final_url"], [F.col("_captured").desc_nulls_last(), F.col("status"), F.col("body")])
    unsafe = (F.col("error_code") == "unsafe_url") & (F.col("error_detail") != NO_TARGET)
    status = F.when(F.coalesce(unsafe, F.lit(False)), 403).when(~is_redirect("status"), F.col("status"))
    joined = chains.join(answers, "final_url", "left").withColumn("_status", status)
    body = F.when(F.col("_status").between(200, 299), F.col("body"))
    return joined.select(F.col("_site").alias("host"), F.col("_status").alias("status"), body.alias("body"))


def host_rules(robots: DataFrame, agent: str, respect: bool = True, fail_closed: bool = True) -> DataFrame:
    """robots.txt responses (host, status, body; one row per host) → one row per host with its verdict and its rules."""
    verdict = robots_status("status", F.octet_length("body"), respect, fail_closed)
    hosts = robots.select("host", verdict.alias("_verdict"), "body")
    rules = robots_rules(parse_robots(hosts.filter("_verdict.robots_status = 'allowed'")), agent)
    return hosts.drop("body").join(rules, "host", "left")


def apply_rules(
    urls: DataFrame,
    rules: DataFrame,
    respect: bool = True,
    fail_closed: bool = True,
    url: str = "url",
) -> DataFrame:
    """Add ``robots_status``, ``crawl_delay`` and, where denied, ``error_code``/``error_detail`` to URLs with a ``host``.

    A host without a response counts as one that could not be reached.
    """
    missing = robots_status(F.lit(None).cast("int"), F.lit(None).cast("int"), respect, fail_closed)
    joined = urls.join(rules, "host", "left").withColumn("_verdict", F.coalesce("_verdict", missing))
    path = url_parts(url)["path"]
    # an empty rule list, or a host without rules, allows everything
    blocked = (F.col("_verdict.robots_status") == "allowed") & ~F.coalesce(path_allowed(path, "rules"), F.lit(True))
    joined = joined.withColumn("_blocked", F.coalesce(blocked, F.lit(False)))
    blocked, verdict = F.col("_blocked"), F.col("_verdict")
    return joined.select(
        *urls.columns,
        F.when(~blocked & verdict["error_code"].isNull(), verdict["robots_status"]).alias("robots_status"),
        F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"),
        F.when(blocked, F.lit("robots_denied")).otherwise(verdict["error_code"]).alias("error_code"),
        F.when(blocked, F.lit("robots.txt does not allow this URL")).otherwise(verdict["error_detail"]).alias("error_detail"),
    )


def robots_gate(
    urls: DataFrame, robots: DataFrame, agent: str, respect: bool = True, fail_closed: bool = True, url: str = "url"
) -> DataFrame:
    """:func:`apply_rules` straight from the robots.txt responses."""
    return apply_rules(urls, host_rules(robots, agent, respect, fail_closed), respect, fail_closed, url)


def schedule_requests(
    df: DataFrame,
    domain: str,
    arrival: str,
    tie: Sequence[str],
    delay: Column | str,
    limits: DataFrame | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Politeness schedule: a request starts when it arrives or when its domain is free again, whichever is later.

    All times are BIGINT microseconds; ``delay`` is how long a request keeps its domain busy, and ``tie`` makes
    (arrival, tie) unique. ``limits`` (domain, next_allowed) carries the schedule on from earlier requests. Adds
    ``start_at`` and ``next_allowed``.

    With ``busy`` the delays of the requests before, ``start = busy + max(next_allowed, max(arrival - busy))`` over the
    requests so far, so no loop is needed. The table is cut into ranges of equal size, and both running values are carried from range
    to range: a domain of any size is worked on by many tasks. Ranges follow the domains, so a border cuts one domain at most and there are
    fewer carries than ``chunks``, which bounds the broadcast.
    """
    work = df.withColumn("_delay", col(delay)).withColumn("_arrival", F.col(arrival))
    order = [arrival, *tie]
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(domain, "_chunk").orderBy(*order)
    rows = (
        ordered_chunks(work, [domain], order, chunks)
        .withColumn("_busy", F.coalesce(F.sum("_delay").over(inside.rowsBetween(*before)), F.lit(0)))
        .withColumn("_peak", F.max(F.col("_arrival") - F.col("_busy")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    ranges = rows.groupBy(domain, "_chunk").agg(F.sum("_delay").alias("_sum"), F.max("_peak").alias("_top"))
    along = Window.partitionBy(domain).orderBy("_chunk")
    carries = (
        ranges.withColumn("_base", F.sum("_sum").over(along.rowsBetween(*before)))
        .withColumn("_reach", F.max(F.col("_top") - F.coalesce("_base", F.lit(0))).over(along.rowsBetween(*before)))
        .filter("_base IS NOT NULL")
        .select(domain, "_chunk", "_base", "_reach")
    )
    slack = rows.join(F.broadcast(carries), [domain, "_chunk"], "left")
    base = F.coalesce("_base", F.lit(0))
    slack = slack.withColumn("_peak", F.greatest(F.col("_peak") - base, "_reach")).withColumn("_busy", F.col("_busy") + base)
    if limits is not None:
        free = limits.select(F.col(domain), F.col("next_allowed").alias("_free"))
        slack = slack.join(free, domain, "left").withColumn("_peak", F.greatest("_peak", "_free")).drop("_free")
    start = F.col("_busy") + F.col("_peak")
    return slack.withColumn("start_at", start).withColumn("next_allowed", start + F.col("_delay")).select(
        *df.columns, "start_at", "next_allowed"
    )


def with_robots_requests(requests: DataFrame, delay: Column | str) -> DataFrame:
    """Both request kinds of a fetch, for the schedule: robots.txt first (``step`` 0), the page next (``step`` 1).

    A robots request keeps its domain busy for the domain delay, the page for the larger of it and the crawl delay.
    """
    steps = F.array(
        F.struct(F.lit(0).alias("step"), col(delay).alias("delay")),
        F.struct(
            F.lit(1).alias("step"),
            F.greatest(col(delay), (F.col("crawl_delay") * 1_000_000).cast("bigint")).alias("delay"),
        ),
    )
    return requests.select("*", F.inline(steps))


def next_allowed(schedule: DataFrame, domain: str) -> DataFrame:
    """The per-domain limits after a schedule, to carry into the next one."""
    return schedule.groupBy(domain).agg(F.max("next_allowed").alias("next_allowed"))
