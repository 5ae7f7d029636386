"""Job tables, sinks and metrics on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from pressroom.operators.jobs import (
    backlog,
    cascade_to_jobs,
    cascade_to_searches,
    classify_error,
    classify_items,
    continuation_decision,
    current_owner,
    date_report,
    expire_leases,
    fill_placeholder,
    job_counters,
    job_detail,
    public_id,
    recent_job_details,
    report_by_month,
    single_active,
    transition_items,
    visible_items,
    with_month_map,
)
from pressroom.operators.metrics import metrics_long, render_metrics
from pressroom.plans.flows import run_searches, scrape_batches
from pressroom.schemas import COMMANDS, FETCH_LOG, HEARTBEATS, RESULT_PAGES, ROBOTS, SEEN
from pressroom.sources.sinks import insert_ignore, upsert_latest, write_metrics, write_results

T0 = dt.datetime(2024, 1, 10, 12, 0)


def now():
    return F.lit("2024-01-10 12:00:00").cast("timestamp")


def ago(**delta):
    return T0 - dt.timedelta(**delta)


def test_transitions(spark):
    rows = [(1, None, None, 1), (2, "fetch_failed", True, 2), (3, "fetch_failed", True, 3), (4, "unsafe_url", False, 1), (5, "internal_error", None, 1)]
    df = spark.createDataFrame(rows, "id int, error_code string, retryable boolean, attempts int").withColumn("lease_owner", F.lit("w"))
    got = transition_items(df, now()).orderBy("id").collect()
    assert [r.status for r in got] == ["success", "queued", "failed", "failed", "failed"]
    assert [r.finished_at is None for r in got] == [False, True, False, False, False]
    assert {r.lease_owner for r in got} == {None}


def test_error_classes(spark):
    df = spark.createDataFrame([("fetch_failed", "d", False, True), (None, "boom", False, True), (None, None, None, False)], "c string, d string, r boolean, f boolean")
    got = [tuple(r.e) for r in df.select(classify_error("c", "d", "r", "f").alias("e")).collect()]
    assert got == [("fetch_failed", "d", False), ("internal_error", "Terjadi kesalahan internal", True), (None, None, None)]


LEASED = "id int, status string, attempts int, lease_owner string, lease_until timestamp, error_code string, error_detail string, finished_at timestamp, created_at timestamp"


def leased(spark):
    rows = [
        (1, "running", 3, "w", ago(seconds=1)), (2, "running", 2, "w", ago(seconds=1)), (3, "running", 1, "w", T0), (4, "queued", 0, None, None),
        (5, "queued", 3, None, None), (6, "success", 1, None, None),
    ]
    return spark.createDataFrame([(*r, None, None, None, ago(minutes=r[0])) for r in rows], LEASED)


def test_leases_and_backlog(spark):
    got = {r.id: r for r in expire_leases(leased(spark), now()).collect()}
    assert (got[1].status, got[1].error_code, got[1].error_detail, got[1].lease_owner) == ("failed", "internal_error", "Batas retry worker tercapai", None)
    assert got[1].finished_at == T0 and got[2].status == "running" and got[2].lease_owner == "w"
    assert [i for i in got if got[i].claimable] == [2, 4]
    assert [(r.id, r.position) for r in backlog(leased(spark), now(), ["created_at", "id"]).orderBy("position").collect()] == [(4, 1), (2, 2)]


def test_counters(spark):
    jobs = spark.createDataFrame([(1, "queued", 2), (2, "queued", 2), (3, "queued", 0), (4, "queued", 2), (5, "completed", 0)], "job_id int, status string, total int")
    items = spark.createDataFrame([(1, "success"), (1, "failed"), (2, "success"), (2, "running"), (4, "queued"), (4, "queued")], "job_id int, status string")
    got = {r.job_id: (r.completed, r.succeeded, r.failed, r.status) for r in job_counters(jobs, items).collect()}
    assert got == {1: (2, 1, 1, "completed"), 2: (1, 1, 0, "running"), 3: (0, 0, 0, "queued"), 4: (0, 0, 0, "queued"), 5: (0, 0, 0, "completed")}


def test_smoke_batch_of_loopback_urls(spark):
    urls = [f"https://127.0.0.1/concurrency?item={n}" for n in range(50)]
    batches = spark.createDataFrame([("j", urls), ("k", ["x"] * 101)], "job_id string, urls array<string>")
    jobs = spark.createDataFrame([("j", None, None, None)], "job_id string, start_date date, end_date date, timezone string")
    empty = spark.createDataFrame([], FETCH_LOG)
    items, rejects = scrape_batches(batches, empty, spark.createDataFrame([], ROBOTS), jobs, now(), "newsbot")
    counted = job_counters(jobs.select("job_id", F.lit("queued").alias("status"), F.lit(50).alias("total")), items).first()
    assert (counted.completed, counted.failed, counted.status) == (50, 50, "completed")
    assert {r.error_code for r in items.collect()} == {"unsafe_url"} and [tuple(r) for r in rejects.collect()] == [("k", "too_many")]


def test_dated_batch_end_to_end(spark):
    words = " ".join(["kata"] * 90)

    def html(day):
        return f'<html><head><title>T</title><meta property="article:published_time" content="{day}"></head><body><article><p>{words}</p></article></body></html>'

    log = [
        ("https://n.example/in", 0, 200, None, "text/html", None, html("2024-01-31T23:30:00Z"), None),
        ("https://n.example/out", 0, 200, None, "text/html", None, html("2024-03-01"), None),
        ("https://n.example/moved", 0, 301, "/in", "text/html", None, None, None),
        ("https://n.example/short", 0, 200, None, "text/html", None, "<title>T</title><article><p>x</p></article>", None),
        ("https://n.example/down", 0, 502, None, None, None, None, None),
    ]
    batches = spark.createDataFrame([("j", [f"https://n.example/{p}" for p in ("in", "out", "moved", "short", "down")])], "job_id string, urls array<string>")
    jobs = spark.createDataFrame([("j", dt.date(2024, 2, 1), dt.date(2024, 2, 29), "Asia/Jakarta")], "job_id string, start_date date, end_date date, timezone string")
    robots = spark.createDataFrame([("n.example", 404, None)], ROBOTS)
    items, _ = scrape_batches(batches, spark.createDataFrame(log, FETCH_LOG), robots, jobs, now(), "newsbot")
    got = [(r.status, r.error_code, r.date_status, r.included) for r in items.orderBy("position").collect()]
    assert got == [
        ("success", None, "in_range", True), ("success", None, "out_of_range", False), ("success", None, "in_range", True),
        ("failed", "extraction_failed", "unknown", False), ("queued", "fetch_failed", "not_filtered", None),
    ]
    report = with_month_map(date_report(items, jobs), report_by_month(items, jobs)).first()
    assert (report.in_range, report.out_of_range, report.unknown_date, report.failed, report.pending) == (2, 1, 0, 1, 1)
    assert report.by_month == {"2024-02": 2}
    shown = items.withColumn("has_filter", F.lit(True))
    assert visible_items(shown).count() == 2 and visible_items(shown, include_excluded=True).count() == 5


def test_failed_items_are_unknown_but_reported_as_failed(spark):
    jobs = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 2, 1), "UTC"), (2, None, None, None)], "job_id int, start_date date, end_date date, timezone string")
    rows = [(1, "failed"), (1, "queued"), (1, "running"), (2, "failed")]
    items = spark.createDataFrame(rows, "job_id int, status string").withColumns({"published_utc": F.lit(None).cast("timestamp"), "published_date": F.lit(None).cast("date")})
    classified = classify_items(items, jobs)
    assert sorted((r.job_id, r.status, r.date_status, r.included) for r in classified.collect()) == [
        (1, "failed", "unknown", False), (1, "queued", "not_filtered", None), (1, "running", "not_filtered", None), (2, "failed", "not_filtered", None),
    ]
    report = date_report(classified, jobs).collect()
    assert [(r.job_id, r.unknown_date, r.failed, r.pending) for r in report] == [(1, 0, 1, 2)]
    assert sorted((r.month, r.n) for r in report_by_month(classified, jobs).collect()) == [("2024-01", 0), ("2024-02", 0)]


def test_detail_splits_long_jobs(spark):
    jobs = spark.createDataFrame([(1, T0), (2, T0)], "job_id int, created_at timestamp")
    items = spark.range(250).select(F.lit(1).alias("job_id"), F.col("id").cast("int").alias("position"), F.lit("u").alias("url"))
    rows = job_detail(jobs, items.orderBy(F.col("position").desc())).orderBy("job_id", "chunk").collect()
    assert [(r.job_id, r.chunk, len(r["items"])) for r in rows] == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 0)]
    assert [i.position for r in rows for i in r["items"]] == list(range(250))
    assert len(recent_job_details(jobs, items, limit=1).collect()) == 1


def commands(spark, rows):
    full = [(i, kind, payload, status, None, None, 1, code, detail, T0, None, None) for i, kind, payload, status, code, detail in rows]
    return spark.createDataFrame(full, COMMANDS)


def test_cascades_and_continuations(spark):
    rows = [
        ("c1", "search", "{}", "failed", "fetch_failed", "d"), ("c2", "scrape_batch", "{}", "failed", "x", "d"), ("c3", "search_continue", '{"search_id":"a-1"}', "failed", "x", "d"),
        ("c4", "search_continue", '{"search_id":"b-2"}', "running", None, None), ("c5", "search", '{"search_id":"d4"}', "queued", None, None),
    ]
    jobs = spark.createDataFrame([("c1", "queued"), ("c1", "completed"), ("c2", "queued"), (None, "queued")], "command_id string, status string")
    jobs = jobs.withColumns({"error_code": F.lit(None).cast("string"), "error_detail": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    got = sorted((r.command_id or "", r.status, r.error_code or "") for r in cascade_to_jobs(jobs, commands(spark, rows), now()).collect())
    assert got == [("", "queued", ""), ("c1", "completed", ""), ("c1", "completed", "fetch_failed"), ("c2", "queued", "")]
    runs = spark.createDataFrame([("a1", "ready"), ("b2", "ready"), ("d4", "discovery_complete"), ("e5", "failed")], "search_id string, status string")
    failed = cascade_to_searches(runs, commands(spark, rows))
    assert sorted((r.search_id, r.status) for r in failed.collect()) == [("a1", "failed"), ("b2", "ready"), ("d4", "discovery_complete"), ("e5", "failed")]
    dated = runs.withColumns({"start_date": F.lit("2024-01-01").cast("date"), "timezone": F.lit("UTC"), "end_date": F.when(F.col("search_id") == "d4", F.lit("2024-01-11")).otherwise(F.lit("2024-01-10")).cast("date")})
    decisions = {r.search_id: r.decision for r in continuation_decision(dated, commands(spark, rows), now()).collect()}
    assert decisions == {"a1": "accept", "b2": "conflict_active", "d4": "conflict_future", "e5": "conflict_failed"}
    asked = spark.createDataFrame([("a1", 2), ("a1", 1), ("b2", 3)], "search_id string, id int")
    assert [tuple(r) for r in single_active(asked, commands(spark, rows), ["id"]).collect()] == [("a1", 1)]
    assert spark.range(1).select(public_id(F.lit("0-1-2"))).first()[0] == "012"


def test_stale_completions(spark):
    done = spark.createDataFrame([(1, "w1"), (2, "w1"), (3, "w1"), (4, None)], "id int, owner string")
    leases = spark.createDataFrame([(1, "w1"), (2, "w2"), (3, None), (4, None)], "id int, lease_owner string")
    assert [r.id for r in current_owner(done, leases).collect()] == [1]


def test_placeholder_is_filled_once(spark):
    jobs = spark.createDataFrame([(1, 0, "queued"), (2, 0, "queued"), (3, 1, "running"), (4, 0, "queued")], "job_id int, total int, status string").withColumn("finished_at", F.lit(None).cast("timestamp"))
    found = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "job_id int, urls array<string>")
    filled, items = fill_placeholder(jobs, found, now())
    assert sorted((r.job_id, r.total, r.status, r.finished_at is not None) for r in filled.collect()) == [(1, 2, "queued", False), (2, 0, "completed", True), (3, 1, "running", False), (4, 0, "queued", False)]
    assert sorted(tuple(r) for r in items.collect()) == [(1, 0, "a"), (1, 1, "b")]
    again, more = fill_placeholder(spark.createDataFrame(filled.collect(), filled.schema), found, now())
    assert sorted(again.collect()) == sorted(filled.collect()) and more.count() == 0


def test_upsert_and_insert(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "tie"), ("b", 4, "late"), ("c", None, "none"), ("c", 2, "first")], "k string, t int, v string")
    assert sorted(tuple(r) for r in upsert_latest(base, new, ["k"], ["t"]).collect()) == [("a", 1, "tie"), ("b", 5, "old"), ("c", 2, "first")]
    assert sorted(tuple(r) for r in insert_ignore(base, new.filter("t IS NOT NULL"), ["k"], ["t"]).collect()) == [("a", 1, "old"), ("b", 5, "old"), ("c", 2, "first")]


def test_results_are_written_idempotently(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "job_id int, position int, status string, finished_at timestamp, month string"
    first = spark.createDataFrame([(1, 0, "failed", ago(hours=2), "2024-01"), (2, 0, "success", ago(hours=2), "2023-12")], schema)
    update = spark.createDataFrame([(1, 0, "success", T0, "2024-01"), (1, 1, "success", T0, "2024-01")], schema)
    for batch in (first, update, update, first):
        write_results(batch, path)
    rows = spark.read.parquet(path).select("job_id", "position", "status", "month").collect()
    assert sorted((r.job_id, r.position, r.status, str(r.month)) for r in rows) == [(1, 0, "success", "2024-01"), (1, 1, "success", "2024-01"), (2, 0, "success", "2023-12")]


def test_metrics_text(spark, tmp_path):
    rows = [
        ("1", "search", "queued", None, 2, ago(seconds=90)), ("2", "search_continue", "failed", None, 1, ago(days=1)),
        ("3", "scrape_one", "running", ago(seconds=5), 4, ago(seconds=60)), ("4", "scrape_one", "queued", None, 0, ago(seconds=30)),
    ]
    table = spark.createDataFrame([(i, kind, "{}", status, None, until, attempts, None, None, created, None, None) for i, kind, status, until, attempts, created in rows], COMMANDS)
    beats = spark.createDataFrame([("w1", ago(seconds=29)), ("w2", ago(seconds=30))], HEARTBEATS)
    items = spark.createDataFrame(
        [("b.example", "success", None, None, ago(seconds=3), T0), ("a.example", "failed", "unsafe_url", None, ago(seconds=1), T0),
         ("a.example", "failed", "fetch_failed", None, ago(seconds=2), T0), (None, "running", None, ago(seconds=1), T0, None), ("c.example", "queued", "fetch_failed", None, None, T0)],
        "domain string, status string, error_code string, lease_until timestamp, started_at timestamp, finished_at timestamp",
    )
    lines = render_metrics(metrics_long(table, beats, items, now()), prefix="press")
    path = str(tmp_path / "metrics")
    write_metrics(lines.filter("line NOT LIKE '%c.example%'"), path)
    got = [r.value for r in spark.read.text(path).collect()]
    assert got == [
        "# TYPE press_command_queue_depth gauge", "press_command_queue_depth 2", "# TYPE press_oldest_command_seconds gauge", "press_oldest_command_seconds 90.000",
        "press_active_workers 1", "press_expired_leases 2", 'press_items_total{status="success"} 1', 'press_items_total{status="failed"} 2',
        "press_search_requests_total 3", "press_search_failures_total 1", 'press_errors_total{code="fetch_failed"} 2', 'press_errors_total{code="unsafe_url"} 1',
        'press_domain_latency_seconds{domain="a.example"} 1.500000', 'press_domain_latency_seconds{domain="b.example"} 3.000000',
    ]


def test_search_flow(spark):
    from test_search import one_run

    body = '{"organic_results":[{"link":"https://n.example/a"},{"link":"https://n.example/a#x"},{"link":"https://n.example/tag/b"}]}'
    captured = spark.createDataFrame([("s", 0, 0, 200, body), ("s", 1, 0, 200, body)], RESULT_PAGES)
    runs = one_run(spark).withColumn("timezone", F.lit("UTC"))
    later = F.lit("2024-03-01 00:00:00").cast("timestamp")
    jobs, items, after = run_searches(runs, captured, spark.createDataFrame([], SEEN), later, allowed_domains=["n.example"])
    assert [(r.position, r.url) for r in items.collect()] == [(0, "https://n.example/a")] and jobs.first().total == 1
    state = after.first()
    assert (state.status, state.skipped, state.pages, state.last_result.total) == ("discovery_complete", 5, 2, 1)
    assert run_searches(runs, captured, spark.createDataFrame([], SEEN), now())[0].count() == 0


def test_months_of_repeated_and_empty_jobs(spark):
    """Months become rows after a job's counts are known; ranges of a repeated job are united, its items count once per row."""
    day = dt.date
    rows = [(1, day(2024, 1, 5), day(2024, 2, 5), "UTC"), (1, day(2024, 2, 1), day(2024, 3, 1), "UTC"), (2, day(2024, 5, 1), day(2024, 4, 1), "UTC"), (None, day(2024, 6, 1), day(2024, 6, 2), "UTC")]
    jobs = spark.createDataFrame(rows, "job_id int, start_date date, end_date date, timezone string")
    schema = "job_id int, status string, date_status string, date_basis string, published_utc timestamp, published_date date"
    items = spark.createDataFrame([(1, "success", "in_range", "source_date", None, day(2024, 2, 2)), (1, "success", "unknown", None, None, None)], schema)
    report = report_by_month(items, jobs)
    assert sorted((tuple(r) for r in report.collect()), key=repr) == [(1, "2024-01", 0), (1, "2024-02", 2), (1, "2024-03", 0), (None, "2024-06", 0)]
    plan = report._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in plan[: next(i for i, line in enumerate(plan) if "Generate" in line)])
