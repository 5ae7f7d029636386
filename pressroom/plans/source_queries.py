"""Captured inputs and results as files: written from the given tables, read again by the readers, with the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.urls import host_verdicts
from ..sources.sinks import write_results
from ..sources.tables import latest_captures, read_dns, read_fetch_log
from ..streaming.common import work_folder
from .catalog import query, table
from .url_queries import _RANGES


@query(
    """
    WITH c AS (SELECT event_id % 500 AS page, event_type, event_id, ts, (event_id // 500 % 3)::INTEGER AS hop FROM events)
    SELECT 'https://h' || page || '.example/' AS url, hop, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 301 ELSE 200 END::INTEGER AS status,
      CASE event_type WHEN 'click' THEN '/' || event_id END AS location, length('body ' || event_id)::BIGINT AS bytes, epoch_us(ts) AS fetched_at
    FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY date_trunc('hour', ts) DESC, hop DESC, ts DESC) = 1"""
)
def fetch_log_source(spark, folder):
    """Events as captures in JSON files: the latest capture of every URL, by the hour of its fetch, and in it the last hop."""
    key, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("https://h"), key % 500, F.lit(".example/")).alias("url"),
        (F.floor(key / 500) % 3).cast("int").alias("hop"),
        F.when(kind == "error", 503).when(kind == "click", 301).otherwise(200).alias("status"),
        F.when(kind == "click", F.concat(F.lit("/"), key)).alias("location"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.concat(F.lit("body "), key).alias("body"),
        F.col("ts").alias("fetched_at"),
    )
    path = f"{work_folder(spark, 'captures')}/log"
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    last = latest_captures(read_fetch_log(spark, path, "json"), within="hour")
    return last.select("url", "hop", "status", "location", F.octet_length("body").cast("bigint").alias("bytes"), F.unix_micros("fetched_at").alias("fetched_at"))


@query(
    f"""
    WITH ips AS (SELECT o_custkey, o_orderkey % 256 AS a, (o_orderkey // 256) % 256 AS b, o_custkey % 128 AS c FROM orders)
    SELECT 'c' || o_custkey || '.example' AS host, bool_and(NOT {_RANGES}) AS all_public FROM ips GROUP BY 1"""
)
def dns_source(spark, folder):
    """A DNS snapshot in CSV files, one line per host and address."""
    key = F.col("o_orderkey")
    ip = F.concat_ws(".", key % 256, F.floor(key / 256) % 256, F.col("o_custkey") % 128, F.lit(9))
    path = f"{work_folder(spark, 'dns')}/snapshot"
    table(spark, folder, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit(".example")).alias("host"), ip.alias("ip")).write.csv(path)
    return host_verdicts(read_dns(spark, path, "csv"))


@query(
    """
    SELECT 'c' || o_custkey AS job_id, o_orderkey::INTEGER AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE o_orderstatus END AS status,
      epoch_us(o_orderdate::TIMESTAMP + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS finished_at, 'm' || o_custkey % 12 AS month FROM orders"""
)
def result_sink(spark, folder):
    """Results of every order, then a third of them again with a newer outcome and a third with an older one, which does not count. The second batch comes twice."""
    orders = table(spark, folder, "orders")
    finished = F.col("o_orderdate").cast("timestamp")

    def items(rows, status, at):
        return rows.select(
            F.concat(F.lit("c"), "o_custkey").alias("job_id"), F.col("o_orderkey").cast("int").alias("position"), status.alias("status"), at.alias("finished_at"),
            F.concat(F.lit("m"), F.col("o_custkey") % 12).alias("month"),
        )

    path = f"{work_folder(spark, 'results')}/items"
    write_results(items(orders, F.col("o_orderstatus"), finished), path)
    newer = F.col("o_orderkey") % 3 == 0
    day = F.expr("INTERVAL 1 DAY")
    again = items(orders.filter("o_orderkey % 3 < 2"), F.lit("failed"), F.when(newer, finished + day).otherwise(finished - day))
    for _ in range(2):
        write_results(again, path)
    stored = spark.read.parquet(path)
    return stored.select("job_id", "position", "status", F.unix_micros("finished_at").alias("finished_at"), F.col("month").cast("string").alias("month"))
