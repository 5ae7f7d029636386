"""Reading and running streams.

Each streaming operator has a batch twin; with :func:`run_available` both give the same rows over the same input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType

from ..operators.skew import checkpoint_folder, durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, zone-less timestamps as UTC instants (a watermark needs instants)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    naive = [f.name for f in schema if isinstance(f.dataType, TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/pressroom-{name}-{uuid.uuid4().hex}"


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input there is into a Parquet folder, exactly once over restarts with the same checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The rows that a stream appends over all input there is, read back as a table."""
    folder = work_folder(spark, name)
    write_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all input there is, one call per micro-batch. ``handle`` must give the same result when called again."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class KeyedTable:
    """A table with one row per key, kept in folders by key bucket. A micro-batch reads and replaces the buckets that it touches and no others.

    The new buckets are written aside first and marked with the batch's identifier, then put in place by a dynamic partition
    overwrite. A batch that comes again after its mark puts the same rows in place again, one that comes again before it starts from the table as it was; so a
    failure at any point loses nothing. Two places aside take turns, so nothing piles up.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: str | StructType, buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._stored = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])

    def _read(self, name: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        rows = self._read("table", self._stored)
        return (rows if buckets is None else rows.filter(F.col("_bucket").isin(*buckets))).drop("_bucket")

    def merge(self, batch: int, rows: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``fold(rows of the touched buckets, new rows)`` becomes the content of those buckets. It must keep what it does not replace."""
        aside, mark = f"aside/{batch % 2}", f"marks/{batch % 2}"
        marks = StructType([StructField("batch", LongType())])
        if self._read(mark, marks).filter(F.col("batch") == batch).isEmpty():
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            rows = durable(rows)
            touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets, at most
            if not touched:
                return
            merged = fold(self.read(touched), rows).select(*self.schema.names).withColumn("_bucket", bucket)
            merged.repartition(len(touched), "_bucket").write.mode("overwrite").parquet(f"{self.folder}/{aside}")
            self.spark.createDataFrame([(batch,)], marks).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{mark}")
        replaced = self._read(aside, self._stored).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replaced.partitionBy("_bucket").parquet(f"{self.folder}/table")
