"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

Totals are sums, so an insert is +1 document and +n tokens, a delete the same with a minus, and a revision a delete of the
old count and an insert of the new one. A batch is reduced to one row per group and written once under its identifier; a batch
counts when its commit mark exists, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_of

GROUP = ["source", "lang", "tokenizer"]
COUNTS = "doc_id long, source string, lang string, tokenizer string, n_tokens long"


class BytePairCounter:
    """Counts tokens of a rank file (base64 token, rank per line) with tiktoken; loaded once per Python worker."""

    loaded: dict[str, object] = {}

    def __init__(self, name: str, lines: bytes, pattern: str):
        self.name, self.lines, self.pattern = name, lines, pattern

    def encoding(self):
        if self.name not in self.loaded:
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.lines.splitlines() if x)}
            self.loaded[self.name] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.loaded[self.name]

    def count(self, text: str) -> int:
        return len(self.encoding().encode_ordinary(text))

    @classmethod
    def public(cls, name: str) -> BytePairCounter:
        import public_tokenizers

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            return cls(name, f.read(), public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, counter: BytePairCounter, flag: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, tokenizer, n_tokens, and the boolean column ``flag`` of ``docs`` where one is named.

    A null text has no tokens; a null source, language or identifier stays null and is a group of its own. Repeated rows count
    each. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, langs, texts, *flags = batch.columns
            numbers = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, sources, langs, pa.array([counter.name] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), *flags],
                ["doc_id", "source", "lang", "tokenizer", "n_tokens", *([flag] if flag else [])],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"),
        *([flag] if flag else []),
    )
    return rows.mapInArrow(run, f"{COUNTS}, {flag} boolean" if flag else COUNTS)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as deltas: +1 for an insert, -1 for a delete."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace old counts by new ones, also where a document changed its source, language or tokenizer."""
    return signed(old, -1).unionByName(signed(new, 1))


def rollup(deltas: DataFrame) -> DataFrame:
    """One row per group. Sums combine before the shuffle, so a hot source costs one row per task."""
    return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenTotals:
    """Totals in a shared folder: ``deltas/batch=<id>`` holds a batch's sums, ``commits/batch=<id>`` says that it is whole.

    A batch that fails half-way has no commit and is written again from the start. A commit is one small file, so it exists or
    it doesn't. ``totals`` sums the committed batches only, and drops groups that have come to nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self, batch: int) -> bool:
        return not self._read("commits", "rows long, batch long").filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: int, deltas: DataFrame) -> bool:
        """Applies the batch; False, and nothing done, where it has been applied before."""
        if self.committed(batch):
            return False
        rollup(deltas).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={int(batch)}")
        self.spark.range(1).select(F.lit(1).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/commits/batch={int(batch)}"
        )
        return True

    def totals(self) -> DataFrame:
        parts = self._read("deltas", "source string, lang string, tokenizer string, docs long, tokens long, batch long")
        done = self._read("commits", "rows long, batch long").select("batch")
        return rollup(parts.join(done, "batch", "left_semi")).filter("docs <> 0 OR tokens <> 0")
