"""Registry of runnable queries. Each reads the given tables whole and may come with the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


# a table whose files are no larger than this is spread over the cores where a query asks for it: never more than one default split
SPREAD_BYTES = 128 * 1024 * 1024

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One table, its zone-less timestamps read as UTC instants.

    ``spread`` is for queries that work long on each row: a file of one row group is one task, however many cores there are.
    Only tables of :data:`SPREAD_BYTES` at most are spread, whatever the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    naive = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive})
    if spread:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        if (files.agg(F.sum("length")).first()[0] or 0) <= SPREAD_BYTES:
            df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def case_of(key, values: list):
    """The value at ``key % len(values)``."""
    out = None
    for i, value in enumerate(values):
        hit = F.pmod(key, F.lit(len(values))) == i
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
