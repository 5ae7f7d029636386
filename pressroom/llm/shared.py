"""What the operators of this subpackage share: reading tables, null handling, labelled samples, and what a Python worker holds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import checkpoint_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names near the stems that no column of ``df`` has, however its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def work_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder that the session names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


class Texts:
    """The texts of an Arrow array, read one at a time: a batch of Spark's may hold 10,000 of them."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[str | None]:
        return (t.as_py() for t in self.column)


class Remembered(dict):
    """What ``work_out`` gives for each word. Words of ``LONGEST`` characters at most are remembered, and all forgotten when there are ``MOST``.

    A Python worker lives as long as its executor, so what it remembers is bounded in words and in their length, to some 60 MB at most.
    """

    MOST = 100_000
    LONGEST = 64

    def work_out(self, word: str) -> Any:
        raise NotImplementedError

    def __missing__(self, word: str) -> Any:
        value = self.work_out(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = value
        return value


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC32 of the decimal text of ``doc_id``, modulo ``modulus``; -1 for a null, which no fold takes."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1)).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, holdout: Sequence[int], rows: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1, null identifiers and labels of no row of ``docs`` count as none; a document that is labelled
    twice counts as 1 if any of its labels is 1. The choice is by hash of ``doc_id`` and so the same in every run. The chosen labels are broadcast: they
    are ``rows`` pairs of numbers at most, whatever the size of the table.
    """
    modulus, out = holdout
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .filter(remainder(F.col("doc_id"), modulus) != out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
