"""Job tables: attempt transitions, lease expiry, counters, date reports, failure cascades and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import classify_date, includes_future, month_windows, report_date
from ..functions.text import col
from .skew import ranked

# Limits and messages of the job tables.
MAX_ATTEMPTS = 3
RECENT = 20
ITEMS_PER_ROW = 100
RETRY_LIMIT_DETAIL = "Batas retry worker tercapai"
UNKNOWN_ERROR_DETAIL = "Terjadi kesalahan internal"
ERROR_CODES = ("unsafe_url", "robots_denied", "fetch_failed", "extraction_failed", "internal_error")


def public_id(uuid: Column | str) -> Column:
    """A uuid without its dashes."""
    return F.replace(col(uuid), F.lit("-"), F.lit(""))


def classify_error(code: Column | str, detail: Column | str, retryable: Column | str, failed: Column | str) -> Column:
    """STRUCT(error_code, error_detail, retryable): a known code passes through, any other failure is an internal error
    that may be tried again."""
    known = col(code).isin(*ERROR_CODES)
    known = F.coalesce(known, F.lit(False))
    failed = col(failed)
    return F.struct(
        F.when(failed, F.when(known, col(code)).otherwise(F.lit("internal_error"))).alias("error_code"),
        F.when(failed, F.when(known, col(detail)).otherwise(F.lit(UNKNOWN_ERROR_DETAIL))).alias("error_detail"),
        F.when(failed, F.when(known, col(retryable)).otherwise(F.lit(True))).alias("retryable"),
    )


def transition_items(items: DataFrame, now: Column | str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """New ``status`` and ``finished_at`` after an attempt (columns error_code, retryable, attempts).

    A retryable error with attempts left goes back to the queue; ``finished_at`` is NULL only there. The lease ends.
    """
    failed = F.col("error_code").isNotNull()
    again = failed & F.coalesce(F.col("retryable"), F.lit(False)) & (F.col("attempts") < max_attempts)
    status = F.when(again, "queued").when(failed, "failed").otherwise("success")
    out = items.withColumn("status", status).withColumn(
        "finished_at", F.when(F.col("status") != "queued", col(now))
    )
    return _release(out, F.lit(True))


def _release(df: DataFrame, where: Column) -> DataFrame:
    for name in ("lease_owner", "lease_until"):
        if name in df.columns:
            df = df.withColumn(name, F.when(~where, F.col(name)))
    return df


def lease_expired(now: Column | str) -> Column:
    return (F.col("status") == "running") & F.coalesce(F.col("lease_until") < col(now), F.lit(False))


def claimable(now: Column | str, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Rows a worker may take: attempts left, and queued or running on an expired lease."""
    return (F.col("attempts") < max_attempts) & ((F.col("status") == "queued") | lease_expired(now))


def expire_leases(df: DataFrame, now: Column | str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Fail rows whose lease ran out with no attempts left; adds ``claimable`` for those that may be taken again."""
    df = df.withColumn("_exhausted", lease_expired(now) & (F.col("attempts") >= max_attempts))
    df = df.withColumn("claimable", claimable(now, max_attempts))
    dead = F.col("_exhausted")
    df = (
        df.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))
        .withColumn("error_code", F.when(dead, "internal_error").otherwise(F.col("error_code")))
        .withColumn("error_detail", F.when(dead, RETRY_LIMIT_DETAIL).otherwise(F.col("error_detail")))
        .withColumn("finished_at", F.when(dead, col(now)).otherwise(F.col("finished_at")))
    )
    return _release(df, dead).drop("_exhausted")


def backlog(df: DataFrame, now: Column | str, order: Sequence[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claimable rows with their ``position`` in the queue, from 1. ``order`` must be unique (created_at, id)."""
    return ranked(df.filter(claimable(now, max_attempts)), order, "position")


def current_owner(completions: DataFrame, leases: DataFrame, key: str = "id") -> DataFrame:
    """Stale completion guard: keep a completion only while its owner holds the lease."""
    held = leases.select(key, F.col("lease_owner").alias("owner")).filter("owner IS NOT NULL")
    return completions.join(held, [key, "owner"], "left_semi")


def job_counters(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """completed, succeeded, failed and status of every job, derived from its items.

    A job is completed when all its items are; one that no worker has touched keeps its status.
    """
    status = F.col("status")
    counts = items.groupBy("job_id").agg(
        F.count_if(status.isin("success", "failed")).alias("completed"),
        F.count_if(status == "success").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status != "queued").alias("_started"),
    )
    base = jobs.drop("completed", "succeeded", "failed")
    joined = base.join(counts, "job_id", "left").fillna(0, ["completed", "succeeded", "failed", "_started"])
    derived = (
        F.when(F.col("total") == 0, F.col("status"))
        .when(F.col("completed") == F.col("total"), "completed")
        .when(F.col("_started") > 0, "running")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", derived).drop("_started")


def classify_items(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add date_status, included and date_basis to items (columns job_id, status, published_utc, published_date).

    ``jobs`` has job_id, start_date, end_date, timezone (NULL dates: no filter). Queued items are not classified, and a
    failed item of a dated job is unknown and not included.
    """
    filters = jobs.select("job_id", "start_date", "end_date", "timezone")
    joined = items.join(filters, "job_id", "left")
    none = F.lit(None)
    ok = F.col("status") == "success"
    verdict = classify_date(
        F.when(ok, F.col("published_utc")), F.when(ok, F.col("published_date")), "start_date", "end_date", "timezone"
    )
    waiting = F.struct(
        F.lit("not_filtered").alias("date_status"),
        none.cast("boolean").alias("included"),
        none.cast("string").alias("date_basis"),
    )
    verdict = F.when(F.col("status").isin("success", "failed"), verdict).otherwise(waiting)
    return joined.withColumn("_verdict", verdict).select(*items.columns, "_verdict.*")


def visible_items(items: DataFrame, include_excluded: bool = False) -> DataFrame:
    """Items of a dated job (``has_filter``) are shown only when they are included."""
    if include_excluded:
        return items
    return items.filter(~F.col("has_filter") | F.coalesce("included", F.lit(False)))


def _bucket() -> Column:
    return (
        F.when(F.col("status").isin("queued", "running"), "pending")
        .when(F.col("status") == "failed", "failed")
        .when(F.col("date_status") == "in_range", "in_range")
        .when(F.col("date_status") == "out_of_range", "out_of_range")
        .when(F.col("date_status") == "unknown", "unknown_date")
    )


REPORT_COUNTERS = ("in_range", "out_of_range", "unknown_date", "failed", "pending")


def _dated(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Classified items of jobs with a date filter, with their bucket and their month in the report zone.

    An item says by its date_basis which of its two dates it was classified by.
    """
    filters = jobs.filter("start_date IS NOT NULL AND end_date IS NOT NULL")
    filters = filters.select("job_id", "start_date", "end_date", "timezone")
    joined = items.join(filters, "job_id")
    instant = (F.col("date_basis") == "report_timezone") & F.col("published_utc").isNotNull()
    day = F.when(instant, report_date("published_utc", "timezone")).otherwise(F.col("published_date"))
    return joined.withColumn("_bucket", _bucket()).withColumn("month", F.date_format(day, "yyyy-MM"))


def date_report(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Five counters per job with a date filter (jobs without items count zero)."""
    counted = _dated(items, jobs).groupBy("job_id").agg(
        *[F.count_if(F.col("_bucket") == name).alias(name) for name in REPORT_COUNTERS]
    )
    filters = jobs.filter("start_date IS NOT NULL AND end_date IS NOT NULL").select("job_id")
    return filters.join(counted, "job_id", "left").fillna(0, list(REPORT_COUNTERS))


def report_by_month(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, month, n): items in range per month of the report zone, zero for the other months of the range."""
    counts = (
        _dated(items, jobs)
        .filter("_bucket = 'in_range' AND month IS NOT NULL")
        .groupBy("job_id", "month")
        .agg(F.count("*").alias("n"))
    )
    filters = jobs.filter("start_date IS NOT NULL AND end_date IS NOT NULL")
    # a job's months become rows only here, after its counts are known: before a shuffle they would be many times the jobs in the tasks that read them
    spans = filters.groupBy("job_id").agg(F.collect_set(F.struct("start_date", "end_date")).alias("_spans"))
    by_job = counts.groupBy("job_id").agg(F.collect_list(F.struct("month", "n")).alias("_counts"))

    def months(span: Column) -> Column:
        names = F.transform(month_windows(span["start_date"], span["end_date"]), lambda w: F.date_format(w["window_start"], "yyyy-MM"))
        return F.coalesce(names, F.array().cast("array<string>"))

    none = F.array().cast("array<struct<month:string,n:bigint>>")
    counted = F.coalesce("_counts", none)
    empty = F.array_except(F.array_distinct(F.flatten(F.transform("_spans", months))), counted["month"])
    zeros = F.transform(empty, lambda month: F.struct(month.alias("month"), F.lit(0).cast("bigint").alias("n")))
    return spans.join(by_job, "job_id", "left").select("job_id", F.inline(F.concat(counted, zeros)))


def with_month_map(report: DataFrame, months: DataFrame, key: str = "job_id") -> DataFrame:
    """The report with ``by_month`` as a map; at most 120 months per job."""
    maps = months.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias("by_month")
    )
    return report.join(maps, key, "left")


def job_detail(jobs: DataFrame, items: DataFrame, per_row: int = ITEMS_PER_ROW) -> DataFrame:
    """Jobs with their items nested in order of position.

    Intake gives a job at most ``per_row`` items, so a job is one row. A longer job continues in further rows
    (``chunk`` 1, 2, …): nothing is left out and no array grows without bound. A job without items has an empty array.
    """
    fields = [c for c in items.columns if c != "job_id"]
    nested = items.groupBy("job_id", F.floor(F.col("position") / per_row).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("position", *[c for c in fields if c != "position"]))).alias("items")
    )
    empty = F.array().cast(nested.schema["items"].dataType)
    return (
        jobs.join(nested, "job_id", "left")
        .withColumn("items", F.coalesce("items", empty))
        .withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    )


def recent_jobs(jobs: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest jobs; the id breaks ties."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def recent_job_details(jobs: DataFrame, items: DataFrame, limit: int = RECENT) -> DataFrame:
    """Latest jobs with their items, in one join instead of one read per job."""
    top = recent_jobs(jobs, limit)
    wanted = items.join(F.broadcast(top.select("job_id")), "job_id", "left_semi")
    return job_detail(top, wanted)


def recent_searches(runs: DataFrame, limit: int = RECENT) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("search_id").desc()).limit(limit)


def items_in_order(items: DataFrame) -> DataFrame:
    """Items sorted by job and position, ready to be written in order."""
    return items.orderBy("job_id", "position")


def cascade_to_jobs(jobs: DataFrame, commands: DataFrame, now: Column | str) -> DataFrame:
    """A failed search command completes its placeholder job with the command's error."""
    dead = commands.filter("status = 'failed' AND type = 'search'").select(
        F.col("id").alias("command_id"), F.col("error_code").alias("_code"), F.col("error_detail").alias("_detail"),
        F.lit(True).alias("_dead"),
    )
    joined = jobs.join(dead, "command_id", "left")
    hit = F.coalesce(F.col("_dead"), F.lit(False)) & (F.col("status") != "completed")
    return joined.select(
        *[
            {
                "status": F.when(hit, "completed").otherwise(F.col("status")).alias("status"),
                "error_code": F.when(hit, F.col("_code")).otherwise(F.col("error_code")).alias("error_code"),
                "error_detail": F.when(hit, F.col("_detail")).otherwise(F.col("error_detail")).alias("error_detail"),
                "finished_at": F.when(hit, col(now)).otherwise(F.col("finished_at")).alias("finished_at"),
            }.get(c, F.col(c))
            for c in jobs.columns
        ]
    )


def cascade_to_searches(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """A failed command whose payload names a search fails that search run."""
    dead = (
        commands.filter("status = 'failed'")
        .select(public_id(F.get_json_object("payload", "$.search_id")).alias("search_id"))
        .filter("search_id IS NOT NULL")
        .distinct()
        .withColumn("_dead", F.lit(True))
    )
    joined = runs.join(dead, "search_id", "left")
    return joined.withColumn("status", F.when(F.col("_dead"), "failed").otherwise(F.col("status"))).select(*runs.columns)


def fill_placeholder(jobs: DataFrame, found: DataFrame, now: Column | str) -> tuple[DataFrame, DataFrame]:
    """Undated searches: put the URLs found (job_id, urls) into their placeholder jobs → (jobs, new items).

    A job that is filled or completed already is returned unchanged, so delivering a result twice does no harm. A result
    without URLs completes the job.
    """
    waiting = jobs.filter("total = 0 AND status != 'completed'").select("job_id")
    fresh = found.join(waiting, "job_id", "left_semi")
    items = fresh.select("job_id", F.posexplode("urls").alias("position", "url"))
    sizes = fresh.select("job_id", F.size("urls").alias("_n"))
    n = F.col("_n")
    filled = (
        jobs.join(sizes, "job_id", "left")
        .withColumn("total", F.coalesce(n, F.col("total")))
        .withColumn("status", F.when(n == 0, "completed").when(n > 0, "queued").otherwise(F.col("status")))
        .withColumn("finished_at", F.when(n == 0, col(now)).when(n.isNull(), F.col("finished_at")))
    )
    return filled.select(*jobs.columns), items


def result_status(total: Column | str) -> Column:
    return F.when(col(total) == 0, F.lit("no_results")).otherwise(F.lit("queued"))


def continuation_decision(runs: DataFrame, commands: DataFrame, now: Column | str) -> DataFrame:
    """Add ``decision`` to search runs asked to continue: conflict_failed, conflict_future, complete, conflict_active or
    accept, tested in this order (columns status, start_date, end_date, timezone)."""
    active = active_continuations(commands).withColumn("_active", F.lit(True))
    joined = runs.join(active, "search_id", "left")
    decision = (
        F.when(F.col("status") == "failed", "conflict_failed")
        .when(includes_future("start_date", "end_date", "timezone", now), "conflict_future")
        .when(F.col("status") == "discovery_complete", "complete")
        .when(F.col("_active"), "conflict_active")
        .otherwise("accept")
    )
    return joined.withColumn("decision", decision).select(*runs.columns, "decision")


def active_continuations(commands: DataFrame) -> DataFrame:
    """Searches with a continuation that is queued or running."""
    live = commands.filter("type = 'search_continue' AND status IN ('queued', 'running')")
    return live.select(public_id(F.get_json_object("payload", "$.search_id")).alias("search_id")).distinct()


def single_active(requests: DataFrame, commands: DataFrame, order: Sequence[str]) -> DataFrame:
    """At most one active continuation per search: drop requests for searches that have one, keep the first of the rest."""
    window = Window.partitionBy("search_id").orderBy(*order)
    first = requests.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
    return first.join(active_continuations(commands), "search_id", "left_anti")
