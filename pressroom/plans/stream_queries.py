"""Streaming operators run over all input there is; their results equal those of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.batches import advance_stream, schedule_stream
from ..streaming.common import read_stream, run_available, with_rocksdb, work_folder
from ..streaming.counters import fenced_completions, item_outcomes, running_windows, unique_urls, upsert_stream, worker_beats
from ..streaming.state import completed_jobs, expired_on_stream
from .catalog import query, table
from .fetch_queries import _REQUESTS, _schedule_sql
from .job_queries import _status
from .search_queries import ADVANCE_SQL, search_tables


def _events(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_stream(spark, folder, "events.parquet")


@query(
    """
    WITH w AS (SELECT user_id AS worker_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, max(ts) AS beat FROM events GROUP BY 1, 2)
    SELECT worker_id, epoch_us(start) AS window_start, epoch_us(beat) AS last_beat FROM w"""
)
def stream_worker_beats(spark, folder):
    """Workers alive per hour, the hours that are still open too."""
    beats = _events(spark, folder).select(F.col("user_id").alias("worker_id"), F.col("ts").alias("heartbeat_at"))
    out = running_windows(spark, worker_beats(beats, ttl_seconds=3600), work_folder(spark, "beats"), ["window", "worker_id"], buckets=8)
    return out.select("worker_id", F.unix_micros("window.start").alias("window_start"), F.unix_micros("last_beat").alias("last_beat"))


@query(
    """
    SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type AS status, CASE WHEN event_type = 'error' THEN 'e' || event_id % 2 END AS error_code,
      'd' || user_id % 30 || '.example' AS domain, count(*) AS items, sum(round(value * 100)::BIGINT)::BIGINT AS latency_micros
    FROM events GROUP BY ALL"""
)
def stream_item_outcomes(spark, folder):
    events = _events(spark, folder)
    items = events.select(
        F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id") % 2)).alias("error_code"),
        F.concat(F.lit("d"), F.col("user_id") % 30, F.lit(".example")).alias("domain"),
        F.timestamp_micros(F.unix_micros("ts") - F.round(F.col("value") * 100).cast("bigint")).alias("started_at"),
        F.col("ts").alias("finished_at"),
    )
    out = running_windows(spark, item_outcomes(items), work_folder(spark, "outcomes"), ["window", "status", "error_code", "domain"], buckets=8)
    return out.select(F.unix_micros("window.start").alias("window_start"), "status", "error_code", "domain", "items", "latency_micros")


@query("SELECT DISTINCT floor(value)::BIGINT AS url FROM events")
def stream_unique_urls(spark, folder):
    """First sights; a URL is forgotten when it was not seen for longer than the table's month, so the state is bounded."""
    urls = _events(spark, folder).select(F.floor("value").cast("bigint").alias("url"), "ts")
    return run_available(spark, unique_urls(urls, time="ts", within="31 days"), "unique").select("url")


@query(
    """
    WITH c AS (SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' OR l_linestatus = 'F') AS completed,
      count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
    SELECT job_id, completed, completed - failed AS succeeded, failed FROM c WHERE completed = n"""
)
def stream_completed_jobs(spark, folder):
    """Orders whose lines have all ended, each emitted once."""
    with_rocksdb(spark)
    totals = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("total"))
    lines = read_stream(spark, folder, "lineitem.parquet").select(
        F.col("l_orderkey").alias("job_id"),
        # line numbers repeat within an order here, whole lines don't
        F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("position"),
        _status("l_returnflag", "l_linestatus").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("ended_at"),
    )
    # the lines of an order are shipped within four months
    return run_available(spark, completed_jobs(lines.join(totals, "job_id"), time="ended_at", keep_seconds=150 * 24 * 3600), "completed")


@query(
    """
    WITH l AS (SELECT user_id AS id, arg_max(event_type, ts) AS kind, arg_max(floor(value) % 5, ts)::INTEGER AS attempts, max(ts) AS ts FROM events GROUP BY 1)
    SELECT id, attempts, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status FROM l
    WHERE kind <> 'purchase' AND ts + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"""
)
def stream_expired_leases(spark, folder):
    """Items (users) whose last event extended a lease of ten minutes that has run out since."""
    with_rocksdb(spark)
    events = _events(spark, folder).select(
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "purchase", "done").otherwise("beat").alias("kind"),
        (F.floor("value") % 5).cast("int").alias("attempts"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("lease_until"),
    )
    out = run_available(spark, expired_on_stream(events), "leases")
    return out.select("id", "attempts", "status")


@query(_schedule_sql(_REQUESTS, "arrival, event_id") + " SELECT event_id, (busy + m)::BIGINT AS start_at, (busy + m + delay)::BIGINT AS next_allowed FROM m")
def stream_politeness(spark, folder):
    delay = F.when(F.col("user_id") % 5 == 0, 10_800_000_000).otherwise(3_600_000_000)
    requests = _events(spark, folder).select(
        "event_id", "user_id", F.unix_micros("ts").alias("arrival"), delay.cast("bigint").alias("delay")
    )
    folder = work_folder(spark, "politeness")
    out = schedule_stream(spark, requests, folder, "user_id", "arrival", ["event_id"], "delay")
    return out.select("event_id", "start_at", "next_allowed")


@query("SELECT event_id AS id FROM events WHERE user_id % 7 = event_id % 7 AND event_type <> 'signup'")
def stream_stale_guard(spark, folder):
    owner = F.when(F.col("event_type") != "signup", F.concat(F.lit("w"), F.col("user_id") % 7))
    leases = table(spark, folder, "events").select(F.col("event_id").alias("id"), owner.alias("lease_owner"))
    done = _events(spark, folder).select(
        F.col("event_id").alias("id"), F.concat(F.lit("w"), F.col("event_id") % 7).alias("owner"), F.col("ts").alias("event_time")
    )
    return run_available(spark, fenced_completions(done, leases), "fence").select("id")


@query(
    f"""
    WITH {ADVANCE_SQL}, placed AS (SELECT k, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS position FROM advanced)
    SELECT k::VARCHAR AS search_id, 'c1-' || k AS command_id, md5(k || '|c1-' || k) AS job_id, position::INTEGER AS position, url FROM placed"""
)
def stream_discovery(spark, folder):
    """One command per customer's search, through the checkpointed discovery stream."""
    runs, pages, hits, seen = search_tables(spark, folder)
    commands = read_stream(spark, folder, "customer.parquet").select(
        F.col("c_custkey").cast("string").alias("search_id"), F.concat(F.lit("c1-"), "c_custkey").alias("command_id")
    )
    return advance_stream(spark, commands, runs, pages, hits, seen, work_folder(spark, "discovery"))


@query(
    """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def stream_upsert(spark, folder):
    updates = _events(spark, folder).select("user_id", "event_id", "event_type", "ts")
    schema = "user_id bigint, event_id bigint, event_type string, ts timestamp"
    out = upsert_stream(spark, updates, work_folder(spark, "upsert"), ["user_id"], ["ts", "event_id"], schema, buckets=8)
    return out.select("user_id", "event_id", "event_type")
