"""Windowed counters and dedupe on streams: declarative, with the state bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.jobs import current_owner
from ..operators.metrics import WORKER_TTL_SECONDS
from ..operators.skew import first_per_key
from ..sources.sinks import upsert_latest
from .common import KeyedTable, each_batch


def worker_beats(
    heartbeats: DataFrame, ttl_seconds: int = WORKER_TTL_SECONDS, late: str = "10 minutes", slide_seconds: int | None = None
) -> DataFrame:
    """(window, worker_id, last beat): a worker is alive in every window of TTL length in which it was heard of."""
    length = f"{ttl_seconds} seconds"
    window = F.window("heartbeat_at", length, f"{slide_seconds or ttl_seconds} seconds")
    beats = heartbeats.withWatermark("heartbeat_at", late).groupBy(window.alias("window"), "worker_id")
    return beats.agg(F.max("heartbeat_at").alias("last_beat"))


def item_outcomes(items: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per window: items by status and error code, with the summed latency in microseconds and its count by domain."""
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    return (
        items.withWatermark("finished_at", late)
        .groupBy(F.window("finished_at", window).alias("window"), "status", "error_code", "domain")
        .agg(F.count("*").alias("items"), F.sum(micros).alias("latency_micros"))
    )


def unique_urls(urls: DataFrame, key: str = "url", time: str | None = None, within: str | None = None) -> DataFrame:
    """First sight of every URL on a stream. With ``time`` and ``within`` the state forgets URLs after that long."""
    if time is None or within is None:
        return urls.dropDuplicates([key])
    return urls.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def upsert_stream(
    spark: SparkSession, updates: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], schema: str, buckets: int = 64
) -> DataFrame:
    """Keep the latest row per key of a stream in a table of ``buckets`` folders. Returns the table."""
    kept = KeyedTable(spark, f"{folder}/latest", keys, schema, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*kept.schema.names)
        # of a hot key one row goes on from each task
        newest = first_per_key(rows, keys, [F.col(c).desc_nulls_last() for c in order])
        kept.merge(batch_id, newest, lambda base, new: upsert_latest(base, new, keys, order))

    each_batch(updates, merge, f"{folder}/checkpoint")
    return kept.read()


def running_windows(spark: SparkSession, windows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """A windowed aggregate of a stream as a table that also has the windows that are still open.

    Each micro-batch brings the groups that it changed, which replace what the table has of them. The watermark still bounds the state:
    a window that it has closed changes no more. Returns the table.
    """
    schema = StructType([*windows.schema.fields, StructField("_batch", LongType())])
    kept = KeyedTable(spark, f"{folder}/windows", keys, schema, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        kept.merge(batch_id, batch.withColumn("_batch", F.lit(batch_id).cast("long")), lambda base, new: upsert_latest(base, new, keys, ["_batch"]))

    each_batch(windows, merge, f"{folder}/checkpoint", mode="update")
    return kept.read().drop("_batch")


def fenced_completions(completions: DataFrame, leases: DataFrame, late: str = "1 hour") -> DataFrame:
    """Completions (id, owner, event_time) whose owner holds the lease; stale, late and repeated ones are dropped.

    ``leases`` (id, lease_owner) is a table; a file-based one is read anew for every micro-batch.
    """
    fresh = completions.withWatermark("event_time", late)
    return current_owner(fresh, leases).dropDuplicatesWithinWatermark(["id"])
