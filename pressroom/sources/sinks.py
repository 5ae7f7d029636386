"""Sinks: keyed upserts, the partitioned result table and the metrics text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import durable, first_per_key


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Base with updates applied: the latest row of each key in ``order`` wins, an update wins a tie.

    Only one row per key and task reaches the shuffle, so a key that is updated all the time is not hot.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    latest = [F.col(c).desc_nulls_last() for c in order] + [F.col("_new").desc()]
    return first_per_key(both, keys, latest).drop("_new")


def insert_ignore(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Base plus the first new row of every key that it does not have yet."""
    fresh = first_per_key(updates, keys, [F.col(c) for c in order])
    return base.unionByName(fresh.join(base.select(*keys), list(keys), "left_anti"))


def write_results(items: DataFrame, path: str, partition: str = "month") -> None:
    """Persist items by (job_id, position), latest ``finished_at`` first; writing the same rows again changes nothing.

    ``partition`` must follow from the job (the month it was created in), so that a key never moves. Only the partitions
    that the new rows touch are read and replaced. Rows are rebalanced by partition, so a large month is split over
    several tasks and a small one gives one file.
    """
    spark = items.sparkSession
    try:
        old = spark.read.schema(items.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    latest = [F.col("finished_at").desc_nulls_last()]
    keys = ["job_id", "position"]
    if old is not None:
        # the partitions of one batch are few; as literals they reach the scan as partition filters
        touched = [row[0] for row in items.select(partition).distinct().collect()]
        hit = F.col(partition).isin([name for name in touched if name is not None])
        if None in touched:
            hit = hit | F.col(partition).isNull()
        merged = upsert_latest(old.filter(hit), items, keys, ["finished_at"])
        merged = durable(merged)  # the partitions it reads are the ones it replaces
    else:
        merged = first_per_key(items, keys, latest)
    writer = merged.hint("rebalance", partition).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Metric lines (line_no, line) as one text file; their number does not grow with the tables but for domains."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
