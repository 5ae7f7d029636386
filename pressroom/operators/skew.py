"""Skew-safe building blocks.

One key may hold a third of all rows. An aggregate is safe as it is, since Spark combines before the shuffle, and so is
``row_number() <= n``, since Spark keeps only ``n`` rows per key and task before the shuffle. A join of a hot key against its
one lookup row is split by adaptive execution, which measures the partitions. What is left needs care: a running value
over a hot key's ordered rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where it names none, in a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pressroom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor cannot change what later steps read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# so many rows are grouped in one task where a query sizes its tasks by rows
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame, rows: int = ROWS_PER_TASK) -> int:
    """Tasks of about ``rows`` rows for a table, as many as there are shuffle partitions at least. Counting Parquet files reads their footers only."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order. Spark limits each key to one row per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Cut the table, ordered by (keys, order), into ranges of about equal size and number them in ``_chunk``.

    The columns in ``order`` must make every row distinct, so that no range can be hot. The cut is materialised: the
    range bounds come from a sample, and both uses of the chunks must see the same ones.
    """
    chunks = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(chunks, *keys, *order)
    return durable(ranged.withColumn("_chunk", F.spark_partition_id()))


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", chunks: int | None = None) -> DataFrame:
    """Position of every row in one total order over the whole table, from 1, without a single-task window."""
    cut = ordered_chunks(df, [], order, chunks)
    # one row per chunk: a fixed number, however large the table is
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_chunk").count().select(
        "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).cast("bigint").alias("_offset")
    )
    inner = Window.partitionBy("_chunk").orderBy(*order)
    numbered = cut.withColumn("_local", F.row_number().over(inner)).join(F.broadcast(offsets), "_chunk")
    return numbered.withColumn(name, F.col("_offset") + F.col("_local")).drop("_chunk", "_local", "_offset")
