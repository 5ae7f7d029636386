"""Operational metrics as conditional counts. Together they read each table once (:func:`metrics_long`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .jobs import lease_expired

# Fixed value: a worker is alive while its last heartbeat is younger than this.
WORKER_TTL_SECONDS = 30


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def queue_summary(commands: DataFrame, now: Column | str) -> DataFrame:
    """queue_depth, oldest_seconds (0 if none), expired leases, search_requests and search_failures, in one scan."""
    queued = F.col("status") == "queued"
    search = F.col("type").isin("search", "search_continue")
    return commands.agg(
        F.count_if(queued).alias("queue_depth"),
        F.coalesce(_seconds(F.max(col(now)), F.min(F.when(queued, F.col("created_at")))), F.lit(0.0)).alias("oldest_seconds"),
        F.count_if(lease_expired(now)).alias("expired"),
        F.coalesce(F.sum(F.when(search, F.col("attempts"))), F.lit(0)).cast("bigint").alias("search_requests"),
        F.count_if(search & (F.col("status") == "failed")).alias("search_failures"),
    )


def active_workers(heartbeats: DataFrame, now: Column | str, ttl_seconds: int = WORKER_TTL_SECONDS) -> DataFrame:
    alive = _seconds(col(now), F.col("heartbeat_at")) < ttl_seconds
    return heartbeats.filter(alive).agg(F.count("*").alias("active"))


def item_totals(items: DataFrame, now: Column | str) -> DataFrame:
    return items.agg(
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(lease_expired(now)).alias("expired"),
    )


def errors_by_code(items: DataFrame) -> DataFrame:
    return items.filter("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("total"))


def domain_latency(items: DataFrame) -> DataFrame:
    """Mean seconds from start to finish; summed in whole microseconds, so the order of rows cannot change it."""
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    done = items.filter("domain IS NOT NULL AND finished_at IS NOT NULL")
    return done.groupBy("domain").agg((F.sum(micros) / F.count(micros) / 1_000_000.0).alias("seconds"))


def search_totals(commands: DataFrame) -> DataFrame:
    return commands.filter("type IN ('search', 'search_continue')").agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).cast("bigint").alias("requests"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def _item_groups(items: DataFrame, now: Column | str) -> DataFrame:
    """All item counters per (error_code, domain), in one scan; combined before the shuffle."""
    done = F.col("domain").isNotNull() & F.col("finished_at").isNotNull()
    micros = F.when(done, F.unix_micros("finished_at") - F.unix_micros("started_at"))
    return items.groupBy("error_code", "domain").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(lease_expired(now)).alias("expired"),
        F.count("*").alias("total"),
        F.count_if(done).alias("ended"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("timed"),
    )


def metrics_long(commands: DataFrame, heartbeats: DataFrame, items: DataFrame, now: Column | str) -> DataFrame:
    """All metrics in one long table: ordinal, name, labels (map), value.

    Each table is read once and gives its own rows, and equal metrics add up, which is how expired leases of commands and
    items meet. A mean is a sum of whole microseconds and the number of items ``over`` which it is taken.
    """

    def row(ordinal: int, name: str, value: str, key: str = "", label: Column | str = "", over: str | None = None) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("name"),
            F.lit(key).alias("key"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            F.col(value).cast("double").alias("value"),
            (F.lit(None) if over is None else F.col(over)).cast("bigint").alias("over"),
        )

    parts = [
        (
            queue_summary(commands, now).withColumn("none", F.lit(0)),
            [
                row(0, "command_queue_depth", "queue_depth"),
                row(1, "oldest_command_seconds", "oldest_seconds"),
                row(3, "expired_leases", "expired"),
                row(6, "search_requests_total", "search_requests"),
                row(7, "search_failures_total", "search_failures"),
                # an empty item table still counts zero
                row(4, "items_total", "none", "status", "success"),
                row(5, "items_total", "none", "status", "failed"),
            ],
        ),
        (active_workers(heartbeats, now), [row(2, "active_workers", "active")]),
        (
            _item_groups(items, now),
            [
                row(3, "expired_leases", "expired"),
                row(4, "items_total", "succeeded", "status", "success"),
                row(5, "items_total", "failed", "status", "failed"),
                F.when(F.col("error_code").isNotNull(), row(8, "errors_total", "total", "code", F.col("error_code"))),
                F.when(F.col("ended") > 0, row(9, "domain_latency_seconds", "micros", "domain", F.col("domain"), "timed")),
            ],
        ),
    ]
    rows = [df.select(F.inline(F.filter(F.array(*columns), lambda r: r.isNotNull()))) for df, columns in parts]
    union = rows[0]
    for other in rows[1:]:
        union = union.unionByName(other)
    none = F.create_map().cast("map<string,string>")
    return (
        union.groupBy("ordinal", "name", "key", "label")
        .agg(F.sum("value").alias("value"), F.sum("over").alias("over"))
        .withColumn("value", F.when(F.col("over").isNull(), F.col("value")).otherwise(F.try_divide("value", "over") / 1_000_000.0))
        .select("ordinal", "name", F.when(F.col("key") != "", F.create_map("key", "label")).otherwise(none).alias("labels"), "value")
    )


def render_metrics(metrics: DataFrame, prefix: str = "pressroom") -> DataFrame:
    """Long metrics → Prometheus text lines (line_no, line); the first two metrics are announced as gauges."""
    label = F.element_at(F.map_values("labels"), 1)
    key = F.element_at(F.map_keys("labels"), 1)
    name = F.concat(F.lit(f"{prefix}_"), F.col("name"))
    value = (
        F.when(F.col("name") == "oldest_command_seconds", F.format_string("%.3f", "value"))
        .when(F.col("name") == "domain_latency_seconds", F.format_string("%.6f", "value"))
        .otherwise(F.col("value").cast("bigint").cast("string"))
    )
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), key, F.lit('="'), label, F.lit('"}'))).otherwise(F.lit(""))
    announce = F.when(F.col("ordinal") < 2, F.array(F.concat(F.lit("# TYPE "), name, F.lit(" gauge")))).otherwise(
        F.array().cast("array<string>")
    )
    lines = F.concat(announce, F.array(F.concat(name, labels, F.lit(" "), value)))
    sort_label = F.when(F.size("labels") > 0, label).otherwise(F.lit(""))
    return metrics.select(
        F.struct("ordinal", F.when(F.col("ordinal") >= 8, sort_label).otherwise("").alias("label")).alias("_key"),
        F.posexplode(lines).alias("_step", "line"),
    ).select(F.struct("_key.ordinal", "_key.label", "_step").alias("line_no"), "line")
