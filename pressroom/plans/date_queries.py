"""Date queries over orders and customer: parsing, requests, windows, classification and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import (
    classify_date,
    days_in_month,
    duration_ms,
    includes_future,
    month_windows,
    months_total,
    normalize_date_request,
    parse_article_time,
    report_date,
    stored_date_request,
)
from ..operators.articles import pick_time, time_candidates
from ..operators.jobs import classify_items, date_report, public_id, report_by_month, with_month_map
from .catalog import case_of, query, table

NOW = "2001-08-01T01:30:00Z"
_NAMES = "januari februari maret april mei juni juli agustus september oktober november desember".split()
_MONTH_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "][month(d)]"


def _stamps(orders):
    """An order's instant: its date plus a time of day taken from its key."""
    key = F.col("o_orderkey")
    return orders.withColumns(
        {
            "d": F.to_date("o_orderdate"),
            "hh": (key % 24).cast("int"),
            "mi": (key % 60).cast("int"),
            "ss": (key % 59).cast("int"),
        }
    )


_BASE = """base AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, (o_orderkey % 24)::INTEGER AS hh, (o_orderkey % 60)::INTEGER AS mi,
      (o_orderkey % 59)::INTEGER AS ss FROM orders)"""


@query(
    f"""
    WITH {_BASE},
    t AS (SELECT *, k % 12 AS f, strftime(d, '%Y-%m-%d') AS day, format('{{:02d}}:{{:02d}}', hh, mi) AS hm,
      epoch_us(d::TIMESTAMP) + (hh * 3600 + mi * 60)::BIGINT * 1000000 AS us FROM base)
    SELECT k AS o_orderkey,
      CASE WHEN f IN (0, 9) THEN 'day' WHEN f IN (1, 5, 6, 10) THEN 'minute' WHEN f IN (2, 4) THEN 'second' WHEN f = 3 THEN 'fraction'
           ELSE 'unknown' END AS precision,
      CASE WHEN f IN (7, 8, 11) THEN NULL ELSE day END AS day,
      CASE f WHEN 1 THEN day || 'T' || hm WHEN 2 THEN day || 'T' || hm || format(':{{:02d}}+07:00', ss)
        WHEN 3 THEN day || 'T' || hm || format(':{{:02d}}.125Z', ss) WHEN 4 THEN day || 'T' || hm || format(':{{:02d}}Z', ss)
        WHEN 5 THEN day || 'T' || hm WHEN 6 THEN day || 'T' || hm WHEN 10 THEN day || 'T' || hm END AS local_datetime,
      CASE f WHEN 2 THEN us + ss * 1000000 - 25200000000 WHEN 3 THEN us + ss * 1000000 + 125000 WHEN 5 THEN us - 28800000000
        WHEN 6 THEN us + 12600000000 WHEN 10 THEN us - 32400000000 END AS utc_us,
      CASE f WHEN 2 THEN '+07:00' WHEN 3 THEN '+00:00' WHEN 5 THEN '+08:00' WHEN 6 THEN '-03:30' WHEN 10 THEN '+09:00' END AS zone
    FROM t"""
)
def parse_times(spark, folder):
    """Order dates written in twelve formats, three of which must not parse, and parsed again."""
    df = _stamps(table(spark, folder, "orders", spread=True))
    day = F.date_format("d", "yyyy-MM-dd")
    hm = F.format_string("%02d:%02d", "hh", "mi")
    hms = F.format_string("%02d:%02d:%02d", "hh", "mi", "ss")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.month("d"))
    named = F.concat_ws(" ", F.day("d"), F.initcap(name), F.year("d"))
    raw = case_of(
        F.col("o_orderkey"),
        [
            F.concat(F.lit(" "), day, F.lit("\n")),
            F.concat(day, F.lit("T"), hm),
            F.concat(day, F.lit(" "), hms, F.lit("+0700")),
            F.concat(day, F.lit("T"), hms, F.lit(".12500z")),
            F.concat(day, F.lit(" "), hms),
            F.concat(F.lit("Terbit: Kamis, "), named, F.lit(" pukul "), F.replace(hm, F.lit(":"), F.lit(".")), F.lit(" WITA")),
            F.concat(day, F.lit("T"), hm, F.lit("-03:30")),
            F.concat(day, F.lit(" "), hms, F.lit(" +07:00")),
            F.concat(day, F.lit("T"), hms, F.lit(".5")),
            F.upper(named),
            F.concat(named, F.lit(", "), hm, F.lit("wit")),
            F.concat(F.lit("31 Februari "), F.year("d")),
        ],
    )
    parsed = df.select("o_orderkey", parse_article_time(raw).alias("t"))
    return parsed.select(
        "o_orderkey", "t.precision", F.col("t.date").cast("string").alias("day"), "t.local_datetime",
        F.unix_micros("t.utc").alias("utc_us"), F.col("t.timezone").alias("zone"),
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'last' WHEN 3 THEN 'first' END AS source,
      CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
      CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT12:00Z')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'kemarin' END AS raw
    FROM orders"""
)
def pick_times(spark, folder):
    """First candidate that parses; the fallback when none does; the first raw text when that does not either."""
    key = F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    first = F.when(key == 0, day).when(key.isin(2, 3), "kemarin").otherwise("  ")
    second = F.when(key < 2, F.concat(day, F.lit("T12:00Z"))).otherwise("")
    last = F.when(key == 2, day).otherwise("lusa")
    picked = pick_time(time_candidates([(first, "first"), (second, "second")], (last, "last")))
    rows = table(spark, folder, "orders", spread=True).select("o_orderkey", picked.alias("t"))
    return rows.select("o_orderkey", "t.source", F.col("t.date").cast("string").alias("day"), "t.raw")


def _customer_ranges(spark, folder):
    dates = F.to_date("o_orderdate")
    ranges = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min(dates).alias("s"), F.max(dates).alias("e"))
    return ranges


_RANGES = "r AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1)"


@query(
    f"""
    WITH {_RANGES},
    m AS (SELECT o_custkey, s, e, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH))::DATE AS first FROM r)
    SELECT o_custkey, (date_diff('month', s, first))::INTEGER AS month_index, greatest(s, first)::VARCHAR AS window_start,
           least(e, last_day(first))::VARCHAR AS window_end, day(last_day(first))::INTEGER AS days,
           (date_diff('month', s, e) + 1)::INTEGER AS months
    FROM m"""
)
def customer_month_windows(spark, folder):
    """The span of every customer's orders, cut into calendar months."""
    ranges = _customer_ranges(spark, folder)
    windows = ranges.select("o_custkey", "s", "e", F.explode(month_windows("s", "e")).alias("w"))
    return windows.select(
        "o_custkey",
        "w.month_index",
        F.col("w.window_start").cast("string").alias("window_start"),
        F.col("w.window_end").cast("string").alias("window_end"),
        days_in_month(F.col("w.window_start")).alias("days"),
        months_total("s", "e").alias("months"),
    )


@query(
    """
    WITH t AS (SELECT o_orderkey AS k, o_orderkey % 12 AS f, o_orderdate::DATE AS d,
      (o_orderkey % 31 + 1)::INTEGER AS n, (o_orderkey % 12 + 1)::INTEGER AS m, DATE '2001-08-01' AS today FROM orders),
    u AS (SELECT *, CASE
        WHEN f = 0 THEN CASE WHEN n > 1 THEN 'future_date' END
        WHEN f = 1 THEN CASE WHEN k % 24 % 12 + 1 > 8 THEN 'future_date' END
        WHEN f = 2 THEN CASE WHEN year(d) > 2001 THEN 'future_date' END
        WHEN f = 3 THEN CASE WHEN d < DATE '1991-09-01' THEN 'too_many_months' END
        WHEN f = 5 THEN 'reversed_range' WHEN f = 6 THEN 'ambiguous_selectors' WHEN f = 7 THEN 'selector_with_range'
        WHEN f = 8 THEN 'end_without_start' WHEN f = 9 THEN 'unknown_timezone' WHEN f = 10 THEN 'future_date'
        WHEN f = 11 THEN 'too_many_months' END AS error FROM t)
    SELECT k AS o_orderkey, error,
      CASE WHEN error IS NULL THEN CASE f WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'start_date' WHEN 4 THEN 'range' END END AS mode,
      CASE WHEN error IS NULL THEN (CASE f WHEN 0 THEN make_date(2001, 8, n) WHEN 1 THEN make_date(2001, m, 1)
        WHEN 2 THEN make_date(year(d), 1, 1) ELSE d END)::VARCHAR END AS start_date,
      CASE WHEN error IS NULL THEN (CASE f WHEN 0 THEN make_date(2001, 8, n) WHEN 1 THEN least(last_day(make_date(2001, m, 1)), today)
        WHEN 2 THEN least(make_date(year(d), 12, 31), today) WHEN 3 THEN today ELSE d END)::VARCHAR END AS end_date
    FROM u"""
)
def normalize_requests(spark, folder):
    """Date selectors of every kind, valid and not, from order dates, against a fixed now."""
    k = F.col("o_orderkey")
    f = k % 12
    d = F.to_date("o_orderdate")
    none = F.lit(None)
    day = F.when(f.isin(0, 6), (k % 31 + 1).cast("int"))
    month = F.when(f.isin(1, 6), (k % 12 + 1).cast("int"))
    year = F.when(f.isin(2, 7), F.year(d))
    start = (
        F.when(f.isin(3, 4, 7, 9), d)
        .when(f == 5, F.date_add(d, 1))
        .when(f == 10, F.lit("2001-08-02").cast("date"))
        .when(f == 11, F.add_months(d, -120))
        .otherwise(none.cast("date"))
    )
    end = F.when(f.isin(4, 5, 8, 9, 11), d).otherwise(none.cast("date"))
    zone = F.when(f == 9, "Mars").otherwise("Asia/Jakarta")
    now = F.lit(NOW).cast("timestamp")
    request = normalize_date_request(day, month, year, start, end, zone, now)
    rows = table(spark, folder, "orders", spread=True).select(k, request.alias("r"))
    return rows.select(
        "o_orderkey", "r.error", "r.mode", F.col("r.start_date").cast("string").alias("start_date"),
        F.col("r.end_date").cast("string").alias("end_date"),
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'legacy_range' END AS mode,
      CASE o_orderkey % 3 WHEN 0 THEN 9 END AS month,
      CASE o_orderkey % 3 WHEN 1 THEN o_orderdate::DATE::VARCHAR END AS start_date,
      o_orderdate::DATE + 30 > DATE '2001-08-01' AS future
    FROM orders"""
)
def stored_requests(spark, folder):
    """Requests read back: as stored, as a legacy range, or none; with the future-range flag."""
    k = F.col("o_orderkey") % 3
    d = F.to_date("o_orderdate")
    stored = F.when(
        k == 0,
        F.struct(
            F.lit("month").alias("mode"),
            F.lit(None).cast("int").alias("day"),
            F.lit(9).alias("month"),
            F.lit(None).cast("int").alias("year"),
            F.lit(None).cast("date").alias("start_date"),
            F.lit(None).cast("date").alias("end_date"),
        ),
    )
    start = F.when(k == 1, d)
    read = stored_date_request(stored, start, F.when(k == 1, d))
    future = includes_future(d, F.date_add(d, 30), F.lit("Asia/Jakarta"), F.lit(NOW).cast("timestamp"))
    rows = table(spark, folder, "orders").select("o_orderkey", read.alias("r"), future.alias("future"))
    return rows.select(
        "o_orderkey", "r.mode", "r.month", F.col("r.start_date").cast("string").alias("start_date"), "future"
    )


_ITEMS = """items AS (SELECT o_orderkey, o_custkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'queued' END AS status,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 20 HOUR END AS utc, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS d FROM orders),
    jobs AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 > 0 THEN make_date((1995 + c_custkey % 6)::INTEGER, (c_custkey % 12 + 1)::INTEGER, 15) END AS s,
      CASE WHEN c_custkey % 5 > 0 THEN make_date((1996 + c_custkey % 6)::INTEGER, (c_custkey % 12 + 1)::INTEGER, 15) END AS e,
      ['UTC', 'Asia/Jakarta', 'Asia/Makassar', 'Asia/Jayapura', 'Mars'][c_custkey % 5 + 1] AS zone,
      [0, 7, 8, 9, 0][c_custkey % 5 + 1] AS hours FROM customer),
    dated AS (SELECT items.*, s, e, CASE WHEN utc IS NOT NULL THEN (utc + to_hours(hours::INTEGER))::DATE ELSE d END AS day FROM items JOIN jobs USING (job_id)),
    classified AS (SELECT *, CASE WHEN status = 'queued' THEN 'not_filtered' WHEN s IS NULL THEN 'not_filtered'
      WHEN status = 'failed' OR day IS NULL THEN 'unknown' WHEN day BETWEEN s AND e THEN 'in_range' ELSE 'out_of_range' END AS date_status FROM dated)"""


def _jobs_and_items(spark, folder):
    """Customers as jobs, four of five with a date filter; their orders as items."""
    key, n = F.col("o_orderkey"), F.col("c_custkey")
    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failed").otherwise("queued")
    items = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("job_id"),
        status.alias("status"),
        F.when(key % 3 == 0, F.timestamp_micros(F.unix_micros("o_orderdate") + 72_000_000_000)).alias("published_utc"),
        F.when(key % 7 != 0, F.to_date("o_orderdate")).alias("published_date"),
    )

    def bound(first_year: int):
        return F.when(n % 5 > 0, F.format_string("%d-%02d-15", n % 6 + first_year, n % 12 + 1).cast("date"))

    zones = F.array(*[F.lit(z) for z in ("UTC", "Asia/Jakarta", "Asia/Makassar", "Asia/Jayapura", "Mars")])
    jobs = table(spark, folder, "customer").select(
        n.alias("job_id"),
        bound(1995).alias("start_date"),
        bound(1996).alias("end_date"),
        F.element_at(zones, (n % 5 + 1).cast("int")).alias("timezone"),
    )
    return jobs, items


def _classified(spark, folder):
    jobs, items = _jobs_and_items(spark, folder)
    return jobs, classify_items(items, jobs)


@query(
    f"""
    WITH {_ITEMS}
    SELECT o_orderkey, date_status, CASE WHEN status = 'queued' OR s IS NULL THEN NULL ELSE date_status = 'in_range' END AS included,
      CASE WHEN status <> 'success' OR s IS NULL THEN NULL WHEN utc IS NOT NULL THEN 'report_timezone' WHEN d IS NOT NULL THEN 'source_date' END AS date_basis
    FROM classified"""
)
def classify_dates(spark, folder):
    _, items = _classified(spark, folder)
    return items.select("o_orderkey", "date_status", "included", "date_basis")


@query(
    f"""
    WITH {_ITEMS}
    SELECT job_id, count(*) FILTER (WHERE status = 'success' AND date_status = 'in_range') AS in_range,
      count(*) FILTER (WHERE status = 'success' AND date_status = 'out_of_range') AS out_of_range,
      count(*) FILTER (WHERE status = 'success' AND date_status = 'unknown') AS unknown_date,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'queued') AS pending
    FROM (SELECT job_id FROM jobs WHERE s IS NOT NULL) LEFT JOIN classified USING (job_id) GROUP BY 1"""
)
def date_reports(spark, folder):
    jobs, items = _classified(spark, folder)
    return date_report(items, jobs)


_MONTHS = """spine AS (SELECT job_id, strftime(unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM jobs WHERE s IS NOT NULL),
    counts AS (SELECT job_id, strftime(day, '%Y-%m') AS month, count(*) AS n FROM classified WHERE status = 'success' AND date_status = 'in_range' GROUP BY 1, 2)"""


@query(f"WITH {_ITEMS}, {_MONTHS} SELECT job_id, month, coalesce(n, 0)::BIGINT AS n FROM spine LEFT JOIN counts USING (job_id, month)")
def reports_by_month(spark, folder):
    jobs, items = _classified(spark, folder)
    return report_by_month(items, jobs)


@query(
    f"""
    WITH {_ITEMS}, {_MONTHS},
    maps AS (SELECT job_id, string_agg(month || '=' || coalesce(n, 0), ',' ORDER BY month) AS by_month
      FROM spine LEFT JOIN counts USING (job_id, month) GROUP BY 1)
    SELECT job_id, by_month FROM maps"""
)
def report_month_maps(spark, folder):
    """``by_month`` as a map, written out as text."""
    jobs, items = _classified(spark, folder)
    report = with_month_map(date_report(items, jobs), report_by_month(items, jobs))
    entries = F.transform(F.map_entries("by_month"), lambda m: F.concat_ws("=", m["key"], m["value"]))
    return report.select("job_id", F.array_join(F.array_sort(entries), ",").alias("by_month"))


@query(
    """
    SELECT l_orderkey, l_linenumber, strftime(l_shipdate + to_hours((l_linenumber % 3 + 7)::INTEGER) + INTERVAL 16 HOUR, '%Y-%m-%d') AS day,
      CASE WHEN l_shipdate + INTERVAL 23 HOUR >= TIMESTAMP '1997-01-01' AND l_shipdate + INTERVAL 23 HOUR < TIMESTAMP '1998-01-01' THEN 'in_range' ELSE 'out_of_range' END AS date_status
    FROM lineitem"""
)
def report_dates(spark, folder):
    """Calendar date of ship instants in the three eastern report zones (16:00 UTC plus seven to nine hours)."""
    zones = F.array(*[F.lit(z) for z in ("Asia/Jakarta", "Asia/Makassar", "Asia/Jayapura")])
    utc = F.timestamp_micros(F.unix_micros("l_shipdate") + 57_600_000_000)
    lines = table(spark, folder, "lineitem")
    verdict = classify_date(
        utc, F.lit(None).cast("date"), F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"), F.lit("Asia/Jakarta")
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        report_date(utc, F.element_at(zones, F.col("l_linenumber") % 3 + 1)).cast("string").alias("day"),
        verdict["date_status"].alias("date_status"),
    )


@query(
    """
    SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS public_id,
      CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN (o_orderkey % 1000) * 2 WHEN 3 THEN 86400000 END::BIGINT AS duration_ms
    FROM orders"""
)
def job_fields(spark, folder):
    """Public ids without dashes; durations of jobs not started, with a clock running backwards, finished and running."""
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string"))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in parts])
    start = F.unix_micros("o_orderdate")
    started = F.when(k % 4 > 0, F.timestamp_micros(start))
    half = (k % 1000) * 2000 + 500  # half a millisecond rounds to the even one
    finished = F.when(k % 4 == 1, F.timestamp_micros(start - 5_000_000)).when(k % 4 == 2, F.timestamp_micros(start + half))
    now = F.timestamp_micros(start + 86_400_000_000)
    return table(spark, folder, "orders").select(
        "o_orderkey", public_id(uuid).alias("public_id"), duration_ms(started, finished, now).alias("duration_ms")
    )
