"""Job-table queries: orders as jobs, their lines as items, events as attempts, commands and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import (
    backlog,
    cascade_to_jobs,
    cascade_to_searches,
    classify_error,
    continuation_decision,
    current_owner,
    expire_leases,
    fill_placeholder,
    items_in_order,
    job_counters,
    job_detail,
    recent_job_details,
    recent_searches,
    result_status,
    single_active,
    transition_items,
    visible_items,
)
from ..operators.metrics import (
    active_workers,
    domain_latency,
    errors_by_code,
    item_totals,
    metrics_long,
    queue_summary,
    render_metrics,
    search_totals,
)
from ..operators.search import progress_by_month, progress_rollup, search_position
from ..operators.skew import tasks_for
from ..sources.sinks import insert_ignore, upsert_latest
from .catalog import query, table

# a fixed instant inside the range of the events
NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _status(flag: str, line: str):
    return (
        F.when(F.col(flag) == "R", "failed")
        .when(F.col(line) == "F", "success")
        .when(F.col(flag) == "A", "running")
        .otherwise("queued")
    )


_LINES = """lines AS (SELECT l_orderkey AS job_id, l_linenumber AS position, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'success'
      WHEN l_returnflag = 'A' THEN 'running' ELSE 'queued' END AS status, l_partkey FROM lineitem)"""


def _lines(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("position"),
        _status("l_returnflag", "l_linestatus").alias("status"),
        F.concat(F.lit("https://shop.example/"), F.col("l_partkey")).alias("url"),
    )


def _jobs(spark, folder) -> DataFrame:
    """Orders as jobs; each eighth one expects a further item."""
    orders = table(spark, folder, "orders")
    totals = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n"))
    jobs = orders.select(
        F.col("o_orderkey").alias("job_id"), F.lit("queued").alias("status"), F.col("o_orderdate").alias("created_at")
    ).join(totals, "job_id", "left")
    extra = F.when(F.col("job_id") % 8 == 0, 1).otherwise(0)
    return jobs.withColumn("total", F.coalesce("n", F.lit(0)) + extra).drop("n")


@query(
    f"""
    WITH {_LINES},
    c AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status IN ('success', 'failed')) AS completed,
      count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status <> 'queued') AS started FROM lines GROUP BY 1)
    SELECT o_orderkey AS job_id, coalesce(n, 0) + (o_orderkey % 8 = 0)::INTEGER AS total, coalesce(completed, 0) AS completed,
      coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed,
      CASE WHEN coalesce(n, 0) + (o_orderkey % 8 = 0)::INTEGER = 0 THEN 'queued'
           WHEN coalesce(completed, 0) = coalesce(n, 0) + (o_orderkey % 8 = 0)::INTEGER THEN 'completed'
           WHEN started > 0 THEN 'running' ELSE 'queued' END AS status
    FROM orders LEFT JOIN c ON job_id = o_orderkey"""
)
def job_counts(spark, folder):
    return job_counters(_jobs(spark, folder), _lines(spark, folder)).select(
        "job_id", "total", "completed", "succeeded", "failed", "status"
    )


@query(
    f"""
    WITH {_LINES}
    SELECT o_orderkey AS job_id, coalesce(string_agg(position || ':' || status || ':https://shop.example/' || l_partkey, ' ' ORDER BY position, status, l_partkey::VARCHAR), '') AS items
    FROM orders LEFT JOIN lines ON job_id = o_orderkey GROUP BY 1"""
)
def job_details(spark, folder):
    """Every job with its items in order of position, written out as text."""
    detail = job_detail(_jobs(spark, folder), _lines(spark, folder))
    text = F.transform("items", lambda i: F.concat_ws(":", i["position"], i["status"], i["url"]))
    return detail.select("job_id", F.array_join(text, " ").alias("items"))


@query(
    f"""
    WITH {_LINES},
    top AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
    SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS created, count(status) AS items,
      count(*) FILTER (WHERE status = 'failed') AS failed
    FROM top LEFT JOIN lines ON job_id = o_orderkey GROUP BY 1, 2"""
)
def recent_job_list(spark, folder):
    detail = recent_job_details(_jobs(spark, folder), _lines(spark, folder))
    failed = F.filter("items", lambda i: i["status"] == "failed")
    return detail.select(
        "job_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.size("items").cast("bigint").alias("items"),
        F.size(failed).cast("bigint").alias("failed"),
    )


@query(
    """
    SELECT o_custkey AS search_id, strftime(max(o_orderdate), '%Y-%m-%d') AS created FROM orders GROUP BY 1
    ORDER BY max(o_orderdate) DESC, o_custkey DESC LIMIT 20"""
)
def recent_search_list(spark, folder):
    runs = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.max("o_orderdate").alias("created_at")
    )
    return recent_searches(runs).select("search_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(f"WITH {_LINES} SELECT job_id, position, status, count(*) AS n FROM lines GROUP BY 1, 2, 3")
def ordered_items(spark, folder):
    """Items sorted by job and position."""
    lines = _lines(spark, folder).groupBy("job_id", "position", "status").agg(F.count("*").alias("n"))
    return items_in_order(lines)


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    WHERE NOT (l_orderkey % 2 = 0) OR l_returnflag = 'R' GROUP BY 1, 2"""
)
def visible_item_rows(spark, folder):
    """Odd jobs show all items, even ones have a date filter and show only included items."""
    lines = table(spark, folder, "lineitem").withColumns(
        {
            "has_filter": F.col("l_orderkey") % 2 == 0,
            "included": F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False),
        }
    )
    return visible_items(lines).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


def _runs(spark, folder) -> DataFrame:
    """Every order as a search that emitted two jobs: its own and the next order's."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("search_id"), F.array(key, key + 1).alias("job_ids")
    )


@query(
    f"""
    WITH {_LINES},
    r AS (SELECT job_id, count(*) FILTER (WHERE status = 'success' AND position > 2) AS in_range,
      count(*) FILTER (WHERE status = 'success' AND position = 2) AS out_of_range,
      count(*) FILTER (WHERE status = 'success' AND position < 2) AS unknown_date,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('queued', 'running')) AS pending FROM lines GROUP BY 1)
    SELECT o_orderkey AS search_id, coalesce(sum(in_range), 0)::BIGINT AS in_range, coalesce(sum(out_of_range), 0)::BIGINT AS out_of_range,
      coalesce(sum(unknown_date), 0)::BIGINT AS unknown_date, coalesce(sum(failed), 0)::BIGINT AS failed, coalesce(sum(pending), 0)::BIGINT AS pending
    FROM orders LEFT JOIN r ON job_id IN (o_orderkey, o_orderkey + 1) GROUP BY 1"""
)
def search_progress(spark, folder):
    """Date reports of each search's jobs, added up in one job instead of one read per job."""
    lines = _lines(spark, folder)
    done = F.col("status") == "success"
    report = lines.groupBy("job_id").agg(
        F.count_if(done & (F.col("position") > 2)).alias("in_range"),
        F.count_if(done & (F.col("position") == 2)).alias("out_of_range"),
        F.count_if(done & (F.col("position") < 2)).alias("unknown_date"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("queued", "running")).alias("pending"),
    )
    return progress_rollup(_runs(spark, folder), report)


@query(
    """
    WITH m AS (SELECT l_orderkey AS job_id, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey AS search_id, month, sum(n)::BIGINT AS n FROM orders JOIN m ON job_id IN (o_orderkey, o_orderkey + 1) GROUP BY 1, 2"""
)
def search_progress_by_month(spark, folder):
    lines = table(spark, folder, "lineitem")
    tasks = tasks_for(lines)
    # a task that reads a large file would count its months in one table in memory, so lines are sent to their job first
    dated = lines.select(F.col("l_orderkey").alias("job_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).repartition(tasks, "job_id")
    months = dated.groupBy("job_id", "month").agg(F.count("*").alias("n"))
    return progress_by_month(_runs(spark, folder), months, tasks)


@query(
    """
    WITH r AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e, count(*) AS n, any_value(o_custkey) % 30 AS m FROM orders GROUP BY 1),
    p AS (SELECT *, date_diff('month', s, e) + 1 AS total, o_custkey % 4 AS k FROM r),
    q AS (SELECT *, greatest(0, least(m - (k = 1)::INTEGER, total)) AS done FROM p),
    w AS (SELECT *, date_trunc('month', s) + to_months(least(done, total - 1)::INTEGER) AS first FROM q)
    SELECT o_custkey AS search_id, total::INTEGER AS months_total, done::INTEGER AS months_completed,
      CASE WHEN k <> 3 THEN greatest(s, first::DATE)::VARCHAR END AS current_start_date,
      CASE WHEN k <> 3 THEN least(e, last_day(first))::VARCHAR END AS current_end_date
    FROM w"""
)
def search_positions(spark, folder):
    day = F.to_date("o_orderdate")
    runs = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date")
    )
    kind = F.col("search_id") % 4
    runs = runs.withColumns(
        {
            "month": (F.col("search_id") % 30).cast("int"),
            "pending": F.when(kind.isin(1, 2), F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")),
            "offset": F.when(kind == 2, 10).otherwise(0),
            "status": F.when(kind == 3, "failed").otherwise("ready"),
        }
    )
    placed = search_position(runs)
    return placed.select(
        "search_id", "months_total", "months_completed", F.col("current_start_date").cast("string").alias("current_start_date"),
        F.col("current_end_date").cast("string").alias("current_end_date"),
    )


def _attempts(events: DataFrame, **more: Column) -> DataFrame:
    """Events as item attempts: errors fail, of which the dearer ones may be tried again."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        "ts",
        (F.floor("value") % 5).cast("int").alias("attempts"),
        F.when(failed, "fetch_failed").alias("error_code"),
        F.when(failed, F.col("value") > 50).alias("retryable"),
        F.concat(F.lit("w"), F.col("user_id") % 7).alias("lease_owner"),
        F.timestamp_micros(F.unix_micros("ts") + 600_000_000).alias("lease_until"),
        *[value.alias(name) for name, value in more.items()],
    )


@query(
    """
    SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN 'success' WHEN value > 50 AND floor(value) % 5 < 3 THEN 'queued' ELSE 'failed' END AS status,
      NOT (event_type = 'error' AND value > 50 AND floor(value) % 5 < 3) AS finished FROM events"""
)
def retry_transition(spark, folder):
    moved = transition_items(_attempts(table(spark, folder, "events")), _now())
    held = F.col("lease_owner").isNotNull() | F.col("lease_until").isNotNull()
    return moved.filter(~held).select("id", "status", F.col("finished_at").isNotNull().alias("finished"))


@query(
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'robots_denied' ELSE 'internal_error' END AS error_code,
      CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN FALSE ELSE TRUE END AS retryable,
      CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN props ELSE 'Terjadi kesalahan internal' END AS error_detail
    FROM events"""
)
def error_classes(spark, folder):
    """Views succeed, errors carry a known code, everything else fails with an unknown one."""
    kind = F.col("event_type")
    code = F.when(kind == "error", "robots_denied").when(kind != "view", kind)
    verdict = classify_error(code, F.col("props"), F.lit(False), kind != "view")
    return table(spark, folder, "events").select("event_id", verdict.alias("e")).select("event_id", "e.*")


def _leased(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type").isin("click", "error"), "running").when(F.col("event_type") == "view", "queued").otherwise("success")
    out = _attempts(events, status=status).drop("error_code", "retryable")
    return out.withColumns(
        {
            "error_code": F.lit(None).cast("string"),
            "error_detail": F.lit(None).cast("string"),
            "finished_at": F.lit(None).cast("timestamp"),
        }
    )


_LEASED = f"""leased AS (SELECT event_id AS id, ts, CASE WHEN event_type IN ('click', 'error') THEN 'running' WHEN event_type = 'view' THEN 'queued' ELSE 'success' END AS status,
      (floor(value) % 5)::INTEGER AS attempts, ts + INTERVAL 10 MINUTE < TIMESTAMP '{NOW}' AS late FROM events)"""


@query(
    f"""
    WITH {_LEASED}
    SELECT id, CASE WHEN status = 'running' AND late AND attempts >= 3 THEN 'failed' ELSE status END AS status,
      CASE WHEN status = 'running' AND late AND attempts >= 3 THEN 'internal_error' END AS error_code,
      attempts < 3 AND (status = 'queued' OR (status = 'running' AND late)) AS claimable,
      NOT (status = 'running' AND late AND attempts >= 3) AS held
    FROM leased"""
)
def expired_leases(spark, folder):
    expired = expire_leases(_leased(table(spark, folder, "events")), _now())
    return expired.select("id", "status", "error_code", "claimable", F.col("lease_owner").isNotNull().alias("held"))


@query(
    f"""
    WITH {_LEASED}
    SELECT id, row_number() OVER (ORDER BY ts, id) AS position FROM leased
    WHERE attempts < 3 AND (status = 'queued' OR (status = 'running' AND late))"""
)
def backlog_order(spark, folder):
    """Queue positions over the whole table, without a single-task window."""
    return backlog(_leased(table(spark, folder, "events")), _now(), ["ts", "id"]).select("id", "position")


@query(
    """
    SELECT event_id AS id FROM events WHERE user_id % 7 = event_id % 7 AND event_type <> 'signup'"""
)
def stale_guard(spark, folder):
    """Completions of worker ``event_id % 7``; the lease is held by worker ``user_id % 7``, or by nobody for signups."""
    events = table(spark, folder, "events")
    key = F.col("event_id").alias("id")
    completions = events.select(key, F.concat(F.lit("w"), F.col("event_id") % 7).alias("owner"))
    owner = F.when(F.col("event_type") != "signup", F.concat(F.lit("w"), F.col("user_id") % 7))
    return current_owner(completions, events.select(key, owner.alias("lease_owner"))).select("id")


def _commands(events: DataFrame) -> DataFrame:
    """Events as commands: their search is the user, errors failed, clicks run and views wait."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(kind == "signup", "scrape_batch").when(F.col("event_id") % 2 == 0, "search").otherwise("search_continue").alias("type"),
        F.to_json(F.struct(F.format_string("u-%d", "user_id").alias("search_id"), F.lit("q").alias("query"))).alias("payload"),
        F.when(kind == "error", "failed").when(kind == "click", "running").when(kind == "view", "queued").otherwise("completed").alias("status"),
        (F.floor("value") % 5).cast("int").alias("attempts"),
        F.when(kind == "error", "fetch_failed").alias("error_code"),
        F.when(kind == "error", F.col("props")).alias("error_detail"),
        F.timestamp_micros(F.unix_micros("ts") + 600_000_000).alias("lease_until"),
        F.col("ts").alias("created_at"),
    )


@query(
    """
    SELECT o_orderkey AS job_id, CASE WHEN dead AND o_orderstatus <> 'F' OR o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS status,
      CASE WHEN dead AND o_orderstatus <> 'F' THEN 'fetch_failed' END AS error_code,
      CASE WHEN dead AND o_orderstatus <> 'F' THEN props END AS error_detail, coalesce(dead AND o_orderstatus <> 'F', FALSE) AS finished
    FROM (SELECT o_orderkey, o_orderstatus, props, event_type = 'error' AND event_id % 2 = 0 AS dead FROM orders LEFT JOIN events ON event_id = o_orderkey)"""
)
def failure_cascade(spark, folder):
    """Failed search commands complete their placeholder jobs; a completed job stays as it is."""
    jobs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderkey").alias("command_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("status"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_detail"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    out = cascade_to_jobs(jobs, _commands(table(spark, folder, "events")), _now())
    return out.select("job_id", "status", "error_code", "error_detail", F.col("finished_at").isNotNull().alias("finished"))


def _searches(spark, folder) -> DataFrame:
    """Customers as search runs, some of them complete, failed, or reaching past now."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("u"), key).alias("search_id"),
        F.when(key % 5 == 0, "discovery_complete").when(key % 5 == 1, "failed").otherwise("ready").alias("status"),
        F.lit("2024-01-01").cast("date").alias("start_date"),
        F.when(key % 7 == 0, F.lit("2024-02-01")).otherwise(F.lit("2024-01-20")).cast("date").alias("end_date"),
        F.lit("Asia/Jakarta").alias("timezone"),
    )


@query(
    """
    SELECT 'u' || c_custkey AS search_id, CASE WHEN c_custkey % 5 = 1 OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'failed'
      WHEN c_custkey % 5 = 0 THEN 'discovery_complete' ELSE 'ready' END AS status FROM customer"""
)
def search_failures(spark, folder):
    runs = cascade_to_searches(_searches(spark, folder), _commands(table(spark, folder, "events")))
    return runs.select("search_id", "status")


def _settled(events: DataFrame) -> DataFrame:
    """All events, those of a value up to 60 as commands that are completed and so hold nothing up."""
    return events.withColumn("event_type", F.when(F.col("value") > 60, F.col("event_type")).otherwise("signup"))


_ACTIVE = "(SELECT user_id FROM events WHERE event_id % 2 = 1 AND event_type IN ('click', 'view') AND value > 60)"


@query(
    f"""
    SELECT 'u' || c_custkey AS search_id, CASE WHEN c_custkey % 5 = 1 THEN 'conflict_failed' WHEN c_custkey % 7 = 0 THEN 'conflict_future'
      WHEN c_custkey % 5 = 0 THEN 'complete' WHEN c_custkey IN {_ACTIVE} THEN 'conflict_active' ELSE 'accept' END AS decision
    FROM customer"""
)
def continuation_decisions(spark, folder):
    commands = _commands(_settled(table(spark, folder, "events")))
    return continuation_decision(_searches(spark, folder), commands, _now()).select("search_id", "decision")


@query(
    f"""
    SELECT 'u' || user_id AS search_id, min(event_id) AS id FROM events WHERE user_id NOT IN {_ACTIVE} GROUP BY user_id"""
)
def single_continuations(spark, folder):
    """Every event asks for a continuation of its user's search; one per search is let through."""
    events = table(spark, folder, "events")
    requests = events.select(F.concat(F.lit("u"), F.col("user_id")).alias("search_id"), F.col("event_id").alias("id"))
    return single_active(requests, _commands(_settled(events)), ["id"]).select("search_id", "id")


_FOUND = "found AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 30) AS urls FROM documents)"


@query(
    f"""
    WITH {_FOUND}
    SELECT doc_id AS job_id, CASE doc_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE len(urls) END::INTEGER AS total,
      CASE WHEN doc_id % 4 = 0 THEN 'running' WHEN doc_id % 4 = 1 OR len(urls) = 0 THEN 'completed' ELSE 'queued' END AS status,
      doc_id % 4 > 1 AND len(urls) = 0 AS finished,
      CASE WHEN doc_id % 4 = 0 THEN 'queued' WHEN doc_id % 4 = 1 OR len(urls) = 0 THEN 'no_results' ELSE 'queued' END AS result
    FROM found"""
)
def fill_placeholders(spark, folder):
    """Documents' long lines fill their placeholder jobs; a quarter is filled already and a quarter is completed."""
    jobs, _ = fill_placeholder(*_placeholders(spark, folder), _now())
    return jobs.select("job_id", "total", "status", F.col("finished_at").isNotNull().alias("finished"), result_status("total").alias("result"))


def _placeholders(spark, folder):
    docs = table(spark, folder, "documents")
    kind = F.col("doc_id") % 4
    jobs = docs.select(
        F.col("doc_id").alias("job_id"),
        F.when(kind == 0, 7).otherwise(0).alias("total"),
        F.when(kind == 0, "running").when(kind == 1, "completed").otherwise("queued").alias("status"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    urls = F.filter(F.split("text", "\n"), lambda line: F.char_length(line) > 30)
    return jobs, docs.select(F.col("doc_id").alias("job_id"), urls.alias("urls"))


@query(
    f"""
    WITH {_FOUND}, rows AS (SELECT doc_id, unnest(urls) AS url, unnest(range(len(urls))) AS position FROM found WHERE doc_id % 4 > 1)
    SELECT doc_id AS job_id, position::INTEGER AS position, url FROM rows"""
)
def placeholder_items(spark, folder):
    return fill_placeholder(*_placeholders(spark, folder), _now())[1]


@query(
    """
    WITH u AS (SELECT user_id, event_type, ts, event_id, 1 AS new FROM events WHERE event_type <> 'view'
               UNION ALL SELECT user_id, event_type, ts, event_id, 0 FROM events WHERE event_type = 'view')
    SELECT user_id, event_type, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def upsert_rows(spark, folder):
    """Latest event per user: views are the base table, all other events update it."""
    events = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    old, new = events.filter("event_type = 'view'"), events.filter("event_type != 'view'")
    return upsert_latest(old, new, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    """
    WITH b AS (SELECT DISTINCT user_id, 'base' AS origin, 0::BIGINT AS event_id FROM events WHERE value > 150),
    n AS (SELECT user_id, 'new' AS origin, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM b) GROUP BY 1)
    SELECT * FROM b UNION ALL SELECT * FROM n"""
)
def insert_ignored(spark, folder):
    events = table(spark, folder, "events")
    base = events.filter("value > 150").select("user_id", F.lit("base").alias("origin"), F.lit(0).cast("bigint").alias("event_id")).distinct()
    new = events.select("user_id", F.lit("new").alias("origin"), "event_id")
    return insert_ignore(base, new, ["user_id"], ["event_id"])


def _metric_tables(spark, folder):
    """Commands and heartbeats from events; items from events with a domain and start and finish times."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    items = events.select(
        F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("d"), F.col("user_id") % 20, F.lit(".example"))).alias("domain"),
        F.when(kind == "error", "failed").when(kind == "click", "running").when(kind == "view", "queued").otherwise("success").alias("status"),
        F.when(kind == "error", F.element_at(F.array(F.lit("fetch_failed"), F.lit("unsafe_url")), (F.col("event_id") % 2 + 1).cast("int"))).alias("error_code"),
        F.timestamp_micros(F.unix_micros("ts") + 1_200_000_000).alias("lease_until"),
        F.col("ts").alias("started_at"),
        F.when(kind.isin("error", "purchase", "signup"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 100).cast("bigint") * 10_000)).alias("finished_at"),
    )
    beats = events.filter(F.col("ts") <= _now()).groupBy((F.col("user_id")).alias("worker_id")).agg(F.max("ts").alias("heartbeat_at"))
    return _commands(events), beats, items


@query(
    f"""
    SELECT count(*) FILTER (WHERE event_type = 'view') AS queue_depth,
      epoch_us(TIMESTAMP '{NOW}') / 1000000 - epoch_us(min(ts) FILTER (WHERE event_type = 'view')) / 1000000 AS oldest_seconds,
      count(*) FILTER (WHERE event_type = 'click' AND ts + INTERVAL 10 MINUTE < TIMESTAMP '{NOW}') AS expired,
      (sum(floor(value) % 5) FILTER (WHERE event_type <> 'signup'))::BIGINT AS search_requests,
      count(*) FILTER (WHERE event_type = 'error') AS search_failures FROM events"""
)
def queue_metrics(spark, folder):
    commands, _, _ = _metric_tables(spark, folder)
    return queue_summary(commands, _now())


@query(
    f"""
    SELECT count(*) AS active FROM (SELECT user_id, max(ts) AS beat FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1)
    WHERE beat > TIMESTAMP '{NOW}' - INTERVAL 3000 SECOND"""
)
def worker_metrics(spark, folder):
    """Workers heard of within fifty minutes (events are sparser than real heartbeats)."""
    _, beats, _ = _metric_tables(spark, folder)
    return active_workers(beats, _now(), ttl_seconds=3000)


@query(
    f"""
    SELECT count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed,
      count(*) FILTER (WHERE event_type = 'click' AND ts + INTERVAL 20 MINUTE < TIMESTAMP '{NOW}') AS expired FROM events"""
)
def item_metrics(spark, folder):
    return item_totals(_metric_tables(spark, folder)[2], _now())


_CODES = "CASE event_id % 2 WHEN 0 THEN 'fetch_failed' ELSE 'unsafe_url' END"
_LATENCY = """SELECT 'd' || (user_id % 20) || '.example' AS domain, sum(round(value * 100)::BIGINT * 10000)::DOUBLE / count(*) / 1000000 AS seconds
    FROM events WHERE event_id % 9 > 0 AND event_type IN ('error', 'purchase', 'signup') GROUP BY 1"""


@query(f"SELECT {_CODES} AS error_code, count(*) AS total FROM events WHERE event_type = 'error' GROUP BY 1")
def error_metrics(spark, folder):
    return errors_by_code(_metric_tables(spark, folder)[2])


@query(f"SELECT domain, round(seconds, 6) AS seconds FROM ({_LATENCY})")
def latency_metrics(spark, folder):
    return domain_latency(_metric_tables(spark, folder)[2]).select("domain", F.round("seconds", 6).alias("seconds"))


@query(
    """
    SELECT (sum(floor(value) % 5))::BIGINT AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events WHERE event_type <> 'signup'"""
)
def search_metrics(spark, folder):
    return search_totals(_metric_tables(spark, folder)[0])


_FIXED = f"""SELECT 'command_queue_depth' AS name, '' AS label, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS value FROM events
    UNION ALL SELECT 'oldest_command_seconds', '', epoch_us(TIMESTAMP '{NOW}') / 1000000 - epoch_us(min(ts) FILTER (WHERE event_type = 'view')) / 1000000 FROM events
    UNION ALL SELECT 'active_workers', '', count(*) FROM (SELECT user_id, max(ts) AS beat FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1) WHERE beat > TIMESTAMP '{NOW}' - INTERVAL 30 SECOND
    UNION ALL SELECT 'expired_leases', '', count(*) FILTER (WHERE ts + INTERVAL 10 MINUTE < TIMESTAMP '{NOW}') + count(*) FILTER (WHERE ts + INTERVAL 20 MINUTE < TIMESTAMP '{NOW}') FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'items_total', 'success', count(*) FROM events WHERE event_type IN ('purchase', 'signup')
    UNION ALL SELECT 'items_total', 'failed', count(*) FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'search_requests_total', '', sum(floor(value) % 5) FROM events WHERE event_type <> 'signup'
    UNION ALL SELECT 'search_failures_total', '', count(*) FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'errors_total', {_CODES}, count(*) FROM events WHERE event_type = 'error' GROUP BY 2
    UNION ALL SELECT 'domain_latency_seconds', domain, seconds FROM ({_LATENCY})"""


@query(f"SELECT name, label, round(value, 6) AS value FROM ({_FIXED})")
def all_metrics(spark, folder):
    rows = metrics_long(*_metric_tables(spark, folder), _now())
    label = F.coalesce(F.get(F.map_values("labels"), F.lit(0)), F.lit(""))
    return rows.select("name", label.alias("label"), F.round("value", 6).alias("value"))


@query(
    f"""
    WITH m AS ({_FIXED})
    SELECT 'pressroom_' || name || CASE name WHEN 'items_total' THEN '{{status="' || label || '"}}' WHEN 'errors_total' THEN '{{code="' || label || '"}}'
      WHEN 'domain_latency_seconds' THEN '{{domain="' || label || '"}}' ELSE '' END || ' ' ||
      CASE name WHEN 'oldest_command_seconds' THEN format('{{:.3f}}', value) WHEN 'domain_latency_seconds' THEN format('{{:.6f}}', value) ELSE value::BIGINT::VARCHAR END AS line FROM m
    UNION ALL SELECT '# TYPE pressroom_' || name || ' gauge' FROM m WHERE name IN ('command_queue_depth', 'oldest_command_seconds')"""
)
def metrics_text(spark, folder):
    return render_metrics(metrics_long(*_metric_tables(spark, folder), _now())).select("line")
