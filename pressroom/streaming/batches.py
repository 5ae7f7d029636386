"""Streams that are run over all input there is, with their results as tables. What they carry lives in the state store of their checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.search import search_books
from ..operators.skew import durable
from .common import with_rocksdb, write_available
from .state import RUN_STATE, SEARCH_STATE, discovered_on_stream, scheduled_on_stream


def schedule_stream(
    spark: SparkSession, requests: DataFrame, folder: str, domain: str, arrival: str, tie: Sequence[str], delay: str
) -> DataFrame:
    """Politeness on a live URL stream, see :func:`pressroom.streaming.state.scheduled_on_stream`. Returns the scheduled requests."""
    with_rocksdb(spark)
    planned = scheduled_on_stream(requests, domain, arrival, tie, delay)
    write_available(planned, f"{folder}/schedule", f"{folder}/checkpoint")
    return spark.read.schema(planned.schema).parquet(f"{folder}/schedule")


def advance_stream(
    spark: SparkSession, commands: DataFrame, runs: DataFrame, pages: DataFrame, hits: DataFrame, seen: DataFrame, folder: str
) -> DataFrame:
    """Resumable discovery, see :func:`pressroom.streaming.state.discovered_on_stream`. Returns the emitted jobs with their URLs.

    The captured pages are put together once per start of the stream, not once per micro-batch.
    """
    with_rocksdb(spark)
    items = discovered_on_stream(commands, runs, durable(search_books(pages, hits)), seen)
    write_available(items, f"{folder}/items", f"{folder}/checkpoint")
    return spark.read.schema(items.schema).parquet(f"{folder}/items")


def discovery_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What :func:`advance_stream` carries, read from its state store: ``run``, ``pending``, ``seen``, ``fingerprints``, ``job_ids`` or ``warnings``, by search_id."""
    def stored(variable: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", variable).load(f"{folder}/checkpoint")

    searches = stored("searches").select("user_map_key.search_id", F.from_json("user_map_value.state", SEARCH_STATE).alias("_state")).select("search_id", "_state.*")
    if name == "run":
        return searches.select("search_id", *StructType.fromDDL(RUN_STATE).names)
    if name == "seen":
        held = searches.select("search_id", F.explode("seen").alias("url"))
        return held.unionByName(stored("seen").select("user_map_key.search_id", "user_map_key.url"))
    return searches.select("search_id", F.explode(name).alias("value"))
