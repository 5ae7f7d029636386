"""Discovery queries: provider pages made from page URLs in blocks of ten, searches made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import (
    advance,
    cut_repeats,
    discover_once,
    discovery_totals,
    emitted_jobs,
    next_runs,
    page_fingerprint,
    request_plan,
    sorted_keys,
    take_first,
    usable_hits,
    valid_search_requests,
)
from ..operators.skew import durable
from ..sources.intake import read_result_pages
from .catalog import case_of, query, table
from .flows import run_searches

DOMAINS = ["example.com", "example.net", "example.org"]


@query(
    """
    WITH r AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1),
    w AS (SELECT *, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH))::DATE AS first FROM r),
    b AS (SELECT *, greatest(s, first) - 1 AS low, least(e, last_day(first)) + 1 AS high FROM w)
    SELECT o_custkey AS search_id, date_diff('month', s, first)::INTEGER AS month_index, o * 10 AS "offset",
      'customer ' || o_custkey || ' (site:example.com OR site:example.net)' AS q,
      'cdr:1,cd_min:' || strftime(low, '%m/%d/%Y') || ',cd_max:' || strftime(high, '%m/%d/%Y') AS tbs
    FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS o)"""
)
def request_plans(spark, folder):
    day = F.to_date("o_orderdate")
    searches = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date")
    )
    searches = searches.withColumn("query", F.concat(F.lit("customer "), "search_id"))
    plan = request_plan(searches, ["Example.com.", " ", "example.net"])
    return plan.select("search_id", "month_index", "offset", "q", "tbs")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'query_length' WHEN o_orderkey % 60 > 50 OR o_orderkey % 60 = 0 THEN 'max_articles'
      WHEN o_orderkey % 7 > 5 OR o_orderkey % 7 = 0 THEN 'max_pages' WHEN o_orderkey % 11 = 0 THEN 'unknown_timezone' END AS reject_reason,
      CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE o_orderpriority END AS query
    FROM orders"""
)
def search_request_checks(spark, folder):
    key = F.col("o_orderkey")
    requests = table(spark, folder, "orders").select(
        key,
        F.when(key % 6 == 0, " x ").otherwise(F.concat(F.lit("\t"), "o_orderpriority", F.lit(" "))).alias("query"),
        (key % 60).cast("int").alias("max_articles"),
        (key % 7).cast("int").alias("max_pages"),
        F.when(key % 11 == 0, "Asia/Tokyo").when(key % 11 == 1, "Asia/Jayapura").alias("timezone"),
    )
    return valid_search_requests(requests, DOMAINS).select("o_orderkey", "reject_reason", "query")


def _captured(spark, folder) -> DataFrame:
    """Provider responses: ten page URLs each (block = page_id div 10), every seventh one spoilt in some way."""
    pages = table(spark, folder, "pages")
    block = F.floor(F.col("page_id") / 10)
    link = F.regexp_replace("url", "^http:", "https:")
    link = case_of(F.col("page_id"), [link, link, F.concat(F.regexp_extract(link, "^https://[^/]*", 0), F.lit("/tag/x")), link, link])
    row = F.when(F.col("page_id") % 11 > 0, F.to_json(F.struct(link.alias("link")))).otherwise('{"title":"no link"}')
    rows = pages.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("page_id", row.alias("row")))).alias("rows"))
    results = F.array_join(F.transform("rows", lambda r: r["row"]), ",")
    following = F.when(F.col("block") % 4 == 3, F.lit("null")).otherwise('"more"')
    good = F.concat(F.lit('{"organic_results":['), results, F.lit('],"serpapi_pagination":{"next":'), following, F.lit("}}"))
    k = F.col("block") % 14
    body = (
        F.when(k == 6, F.lit('{"error":"quota","organic_results":[]}'))
        .when(k == 13, F.lit('{"organic_results":"none"}'))
        .when(k == 9, F.lit("not json"))
        .otherwise(good)
    )
    return rows.select(
        F.floor(F.col("block") / 14).alias("search_id"),
        k.cast("int").alias("page"),
        F.when(k == 10, 503).when(k == 11, 403).otherwise(200).alias("status"),
        body.alias("body"),
    )


_BLOCKS = """p AS (SELECT page_id, page_id // 10 AS block, (page_id // 10) // 14 AS search_id, ((page_id // 10) % 14)::INTEGER AS page,
      (page_id - (page_id // 10) * 10)::INTEGER AS rank, replace(url, 'http:', 'https:') AS url FROM pages),
    links AS (SELECT *, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 2 THEN regexp_extract(url, '^https://[^/?#]*') || '/tag/x' ELSE url END AS link,
      regexp_extract(url, '^https://[^/?#]*') || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
        || regexp_extract(url, '(\\?[^#]*)', 1) AS normal FROM p),
    usable AS (SELECT *, CASE WHEN page_id % 11 = 0 OR page_id % 5 = 2 THEN NULL ELSE normal END AS good FROM links)"""


@query(
    f"""
    WITH {_BLOCKS}
    SELECT search_id, page, count(*) FILTER (WHERE page NOT IN (6, 9, 10, 11, 13)) AS rows,
      CASE WHEN page NOT IN (6, 9, 10, 11) THEN page <> 13 AND any_value(block) % 4 <> 3 END AS has_next,
      CASE WHEN page IN (6, 9, 10, 11) THEN 'fetch_failed' END AS error_code,
      CASE WHEN page IN (6, 11) THEN FALSE WHEN page IN (9, 10) THEN TRUE END AS retryable
    FROM usable GROUP BY 1, 2"""
)
def result_pages(spark, folder):
    read = read_result_pages(_captured(spark, folder))
    return read.select(
        "search_id", "page", F.coalesce(F.size("links"), F.lit(0)).cast("bigint").alias("rows"), "has_next", "error_code", "retryable"
    ).withColumn("rows", F.greatest("rows", F.lit(0).cast("bigint")))


@query(
    f"""
    WITH {_BLOCKS}
    SELECT search_id, page, rank, good AS url FROM usable WHERE page NOT IN (6, 9, 10, 11, 13)"""
)
def usable_results(spark, folder):
    """Every result of every page, in normal form, or NULL where it is to be skipped."""
    hits = usable_hits(read_result_pages(_captured(spark, folder)), allowed_domains=DOMAINS, idna=False)
    return hits.select("search_id", "page", "rank", "url")


@query(
    f"""
    WITH {_BLOCKS}
    SELECT search_id, page, sha256(coalesce(string_agg(link, chr(10) ORDER BY rank), '')) AS fingerprint FROM links
    WHERE page NOT IN (6, 9, 10, 11, 13) GROUP BY 1, 2"""
)
def page_fingerprints(spark, folder):
    read = read_result_pages(_captured(spark, folder)).filter("error_code IS NULL AND size(links) > 0")
    links = F.filter("links", lambda u: u.isNotNull())
    return read.select("search_id", "page", page_fingerprint(links).alias("fingerprint"))


@query(
    """
    WITH e AS (SELECT user_id, event_id AS page, floor(value / 12)::BIGINT AS f, value < 100 AS has_next FROM events),
    m AS (SELECT *, row_number() OVER (PARTITION BY user_id, f ORDER BY page) > 1 AS repeated FROM e),
    s AS (SELECT *, coalesce(bool_or(repeated OR NOT has_next) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS over FROM m)
    SELECT user_id, page, repeated FROM s WHERE NOT over"""
)
def repeat_cutoff(spark, folder):
    """Events as pages of their user's month: cut at the first repeated fingerprint or the first page without a next."""
    pages = table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("page"), F.floor(F.col("value") / 12).alias("fingerprint"), (F.col("value") < 100).alias("has_next")
    )
    return cut_repeats(pages, ["user_id"]).select("user_id", "page", "repeated")


def _event_pages(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Events as search results: ten to a page in order of time, per user; signups are results to be skipped."""
    events = table(spark, folder, "events")
    slot = F.unix_micros("ts").alias("slot")
    # a page per user and day; the rank is the time of day
    day = (F.unix_date(F.to_date("ts")) - 19723).cast("int")
    hits = events.select(
        F.col("user_id").alias("search_id"), day.alias("page"), slot,
        F.when(F.col("event_type") != "signup", F.concat(F.lit("https://n.example/"), F.floor("value"))).alias("url"),
    )
    hits = hits.withColumnRenamed("slot", "rank")
    pages = hits.groupBy("search_id", "page").agg(F.count("*").alias("n")).select("search_id", "page", (F.col("page") % 9 != 8).alias("has_next"))
    return pages, hits


_DISCOVER = """h AS (SELECT user_id AS search_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS page, epoch_us(ts) AS rank,
      CASE WHEN event_type <> 'signup' THEN 'https://n.example/' || floor(value)::BIGINT END AS url FROM events),
    near AS (SELECT * FROM h WHERE page < 20 AND page <= coalesce((SELECT min(page) FROM h x WHERE x.search_id = h.search_id AND x.page % 9 = 8), 1000)),
    k AS (SELECT *, url IS NOT NULL AND row_number() OVER (PARTITION BY search_id, url ORDER BY page, rank) = 1 AS fresh FROM near),
    b AS (SELECT *, coalesce(sum(fresh::INTEGER) OVER (PARTITION BY search_id ORDER BY page RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(fresh::INTEGER) OVER (PARTITION BY search_id ORDER BY page, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)"""


@query(f"WITH {_DISCOVER} SELECT search_id, (upto - 1)::INTEGER AS position, url FROM b WHERE fresh AND upto <= 12")
def discover_urls(spark, folder):
    """Undated search over events as results: first occurrences until the page or the article limit."""
    return discover_once(*_event_pages(spark, folder), max_articles=12, max_pages=20)[0]


@query(
    f"""
    WITH {_DISCOVER}
    SELECT search_id, least(count(*) FILTER (WHERE fresh), 12) AS total, count(DISTINCT page) AS pages_fetched, count(*) FILTER (WHERE NOT fresh) AS skipped
    FROM b WHERE before < 12 GROUP BY 1"""
)
def discover_counts(spark, folder):
    return discover_once(*_event_pages(spark, folder), max_articles=12, max_pages=20)[1]


@query(
    f"""
    WITH {_DISCOVER}, bad AS (SELECT DISTINCT search_id FROM b WHERE before < 12 AND page % 7 = 3 AND search_id % 4 = 0)
    SELECT b.search_id, CASE WHEN bad.search_id IS NULL THEN least(count(*) FILTER (WHERE fresh), 12) ELSE 0 END AS total,
      CASE WHEN bad.search_id IS NOT NULL THEN 'fetch_failed' END AS error_code
    FROM b LEFT JOIN bad ON b.search_id = bad.search_id WHERE before < 12 GROUP BY b.search_id, bad.search_id"""
)
def discover_failures(spark, folder):
    """Undated search where some pages failed: one that is reached fails its search."""
    pages, hits = _event_pages(spark, folder)
    bad = (F.col("page") % 7 == 3) & (F.col("search_id") % 4 == 0)
    urls, totals = discover_once(pages.withColumn("error_code", F.when(bad, "fetch_failed")), hits, max_articles=12, max_pages=20)
    # a failed search has no URLs, so the totals that are returned are those of the URLs
    counted = urls.groupBy("search_id").agg(F.count("*").alias("found"))
    joined = totals.join(counted, "search_id", "left").fillna(0, ["found"])
    return joined.select("search_id", F.col("found").alias("total"), "error_code")


@query(
    """
    WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 4 AS taken FROM orders)
    SELECT o_custkey, count(*) FILTER (WHERE taken) AS taken, count(*) FILTER (WHERE NOT taken) AS carried,
      (sum(o_orderkey) FILTER (WHERE taken))::BIGINT AS taken_keys FROM r GROUP BY 1"""
)
def take_with_carry(spark, folder):
    """First four orders of a customer now, the rest carried over."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    taken, rest = take_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4)
    both = taken.withColumn("now", F.lit(True)).unionByName(rest.withColumn("now", F.lit(False)))
    return both.groupBy("o_custkey").agg(
        F.count_if("now").alias("taken"), F.count_if(~F.col("now")).alias("carried"), F.sum(F.when(F.col("now"), F.col("o_orderkey"))).alias("taken_keys")
    )


@query(
    """
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''))), ' ') AS words FROM documents"""
)
def sorted_distinct_keys(spark, folder):
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    return table(spark, folder, "documents").select("doc_id", F.array_join(sorted_keys(words), " ").alias("words"))


@query(
    """
    SELECT user_id AS search_id, count(DISTINCT floor(value)) AS discovered, count(*) AS pages, sum(event_id % 7)::BIGINT AS skipped FROM events GROUP BY 1"""
)
def discovery_counts(spark, folder):
    events = table(spark, folder, "events")
    seen = events.select(F.col("user_id").alias("search_id"), F.floor("value").cast("string").alias("url"))
    pages = events.select(F.col("user_id").alias("search_id"), (F.col("event_id") % 7).alias("skipped"))
    return discovery_totals(seen, pages)


def search_tables(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as dated searches over three months of captured pages, made from their orders.

    A customer's order is one result of the page (month, offset) that its key names; all pages exist, some are empty.
    """
    customers = table(spark, folder, "customer")
    none = F.array().cast("array<string>")
    key = F.col("c_custkey")
    runs = customers.select(
        key.cast("string").alias("search_id"),
        F.when(key % 17 == 0, "discovery_complete").when(key % 19 == 0, "failed").otherwise("ready").alias("status"),
        F.lit("2024-04-11").cast("date").alias("start_date"),
        F.when(key % 5 == 0, "2024-04-30").otherwise("2024-06-02").cast("date").alias("end_date"),
        (2 + key % 5).cast("int").alias("max_articles"),
        (1 + key % 4).cast("int").alias("max_pages"),
        F.lit(0).alias("month"),
        F.lit(0).alias("offset"),
        F.when(key % 3 == 0, F.array(F.lit("https://n.example/old"))).otherwise(none).alias("pending"),
        none.alias("fingerprints"),
        F.lit(0).alias("pages"),
        F.lit(0).alias("skipped"),
        none.alias("job_ids"),
        none.alias("warnings"),
        F.lit(None).cast("string").alias("last_command_id"),
        F.lit(None).cast("struct<status:string,job_id:string,total:int,pages_fetched:int,skipped:int,urls:array<string>>").alias("last_result"),
        F.lit(0).alias("requests_attempted"),
        F.concat(F.lit("c1-"), key).alias("command_id"),
    )
    places = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("place")
    pages = customers.select(key.cast("string").alias("search_id"), places).select(
        "search_id",
        F.floor(F.col("place") / 2).cast("int").alias("month"),
        (F.col("place") % 2 * 10).cast("int").alias("offset"),
        (F.col("place") % 2 == 0).alias("has_next"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("boolean").alias("retryable"),
    )
    o = F.col("o_orderkey")
    hits = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("search_id"),
        F.floor(o % 6 / 2).cast("int").alias("month"),
        (o % 2 * 10).cast("int").alias("offset"),
        o.cast("int").alias("rank"),
        F.when(o % 7 > 0, F.concat(F.lit("https://n.example/"), F.floor(o / 2) % 40)).alias("url"),
    )
    seen = runs.select("search_id", F.concat(F.lit("https://n.example/"), F.col("search_id").cast("int") % 40).alias("url"))
    return runs, pages, hits, seen


# one command of every search of search_tables; the results of a month come on two pages, so only the second can repeat the first
ADVANCE_SQL = """RECURSIVE hit AS (
      SELECT o_custkey AS k, o_orderkey % 6 // 2 AS month, o_orderkey % 2 AS leaf, o_orderkey AS rank,
        CASE WHEN o_orderkey % 7 > 0 THEN 'https://n.example/' || (o_orderkey // 2 % 40) END AS url FROM orders),
    page AS (SELECT k, month, leaf, count(*) AS n FROM hit GROUP BY ALL),
    firsts AS (SELECT k, month, leaf, url, min(rank) AS rank FROM hit WHERE url <> 'https://n.example/' || (k % 40) GROUP BY ALL),
    news AS (SELECT k, month, leaf, list(url ORDER BY rank) AS urls FROM firsts GROUP BY ALL),
    search AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 3 END AS months, 2 + c_custkey % 5 AS room, 1 + c_custkey % 4 AS turns,
      CASE WHEN c_custkey % 3 = 0 THEN ['https://n.example/old'] ELSE []::VARCHAR[] END AS waiting,
      c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AS live FROM customer),
    walk AS (
      SELECT k, 0 AS turn, 0 AS month, 0 AS leaf, waiting AS urls, 0::BIGINT AS n, 0 AS repeats, FALSE AS bare FROM search WHERE live
      UNION ALL
      SELECT k, turn + 1, month + leaf, 1 - leaf, urls || fresh, n + got, repeats + (leaf = 1 AND bare AND len(fresh) = 0)::INTEGER, len(fresh) = 0
      FROM (
        SELECT w.*, coalesce(p.n, 0) AS got, coalesce(list_filter(f.urls, lambda u: NOT list_contains(w.urls, u)), []::VARCHAR[]) AS fresh
        FROM walk w JOIN search s USING (k) LEFT JOIN page p ON p.k = w.k AND p.month = w.month AND p.leaf = w.leaf
          LEFT JOIN news f ON f.k = w.k AND f.month = w.month AND f.leaf = w.leaf
        WHERE w.turn < s.turns AND w.month < s.months AND len(w.urls) < s.room)),
    last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC) = 1),
    advanced AS (
      SELECT s.k, live, coalesce(turn, 0) AS pages_fetched, coalesce(month, 0) AS month, coalesce(leaf, 0) * 10 AS "offset", coalesce(urls[:room], []) AS urls,
        coalesce(urls[room + 1:], waiting) AS pending, coalesce(n - (len(urls) - len(waiting)), 0) AS skipped, coalesce(repeats, 0) AS repeats,
        CASE WHEN s.k % 17 = 0 OR (month >= months AND len(urls) <= room) THEN 'discovery_complete' WHEN s.k % 19 = 0 THEN 'failed' ELSE 'ready' END AS status
      FROM search s LEFT JOIN last l ON l.k = s.k)"""


@query(
    f"""
    WITH {ADVANCE_SQL}
    SELECT k::VARCHAR AS search_id, CASE WHEN live AND (len(urls) > 0 OR status = 'ready') THEN 'queued' ELSE status END AS result_status, len(urls)::INTEGER AS total,
      pages_fetched::INTEGER AS pages_fetched, skipped::INTEGER AS skipped_now, status, month::INTEGER AS month, "offset"::INTEGER AS "offset",
      array_to_string(urls, ' ') AS urls, array_to_string(pending, ' ') AS pending, repeats::INTEGER AS repeats FROM advanced"""
)
def advance_budget(spark, folder):
    """One command of every dated search, within its own limits of pages and articles."""
    moved = advance(*search_tables(spark, folder))
    return moved.select(
        "search_id", "result_status", "total", "pages_fetched", "skipped_now", "status", "month", "offset", F.array_join("urls", " ").alias("urls"),
        F.array_join("pending", " ").alias("pending"), F.size("warnings").alias("repeats"),
    )


@query(
    f"""
    WITH {ADVANCE_SQL}
    SELECT k::VARCHAR AS search_id, status, live AND (len(urls) > 0 OR status = 'ready' OR pages_fetched > 0) AS moved, TRUE AS unchanged_on_replay FROM advanced"""
)
def advance_replay(spark, folder):
    """The same command twice: the second run gives the stored result and makes no new job."""
    runs, pages, hits, seen = search_tables(spark, folder)
    # both are read several times, and a plan that repeats them grows with every use
    first = durable(advance(runs, pages, hits, seen))
    after = next_runs(runs, first)
    again = durable(advance(after, pages, hits, seen))
    jobs, _ = emitted_jobs(again)
    same = first.select("search_id", F.struct("job_id", "urls", "total").alias("a")).join(
        again.select("search_id", "status", F.struct("job_id", "urls", "total").alias("b"), F.col("replayed").alias("moved")).hint("merge"), "search_id"
    )
    return same.join(jobs.select("search_id").hint("merge"), "search_id", "left_anti").select("search_id", "status", "moved", F.col("a").eqNullSafe(F.col("b")).alias("unchanged_on_replay"))


@query(
    f"""
    WITH {ADVANCE_SQL}, placed AS (SELECT k, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS position FROM advanced)
    SELECT k::VARCHAR AS search_id, md5(k || '|c1-' || k) AS job_id, position::INTEGER AS position, url, DATE '2024-04-11' AS start_date FROM placed"""
)
def dated_search_jobs(spark, folder):
    """The whole flow of a dated search: provider bodies in JSON, usable results, one command per search, the jobs with their URLs and dates."""
    runs, pages, hits, seen = search_tables(spark, folder)
    at = ["search_id", "month", "offset"]
    result = F.struct(F.col("url").alias("link"))
    found = hits.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("rank", result.alias("row")))).alias("ranked"))
    # a result without a link stands on every page, so none is empty
    rows = F.concat(F.coalesce(F.col("ranked.row"), F.array().cast("array<struct<link:string>>")), F.array(F.struct(F.lit(None).cast("string").alias("link"))))
    following = F.struct(F.when(F.col("has_next"), "2").alias("next"))
    body = F.to_json(F.struct(rows.alias("organic_results"), following.alias("serpapi_pagination")))
    captured = pages.join(found, at, "left").select(*at, F.lit(200).alias("status"), body.alias("body"))
    now = F.lit("2024-09-01").cast("timestamp")
    jobs, items, _ = run_searches(runs.withColumn("timezone", F.lit("UTC")), captured, seen, now, idna=False)
    return jobs.join(items, "job_id").select("search_id", "job_id", "position", "url", "start_date")
