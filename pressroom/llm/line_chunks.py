"""Line dedup by content-defined chunks, in DataFrame functions only.

A line's hash is the first 32 bits of its MD5. After a line ends a chunk when the rolling hash over it and the line before,
``(h[i] + 31 h[i-1]) mod 3``, is 0, so an inserted or removed line moves no boundary beyond the next one that agrees. Chunks of two
lines or more that occur more than once in the corpus stay only at their first place.

A passage whose ends are not chunk ends is not found that way. ``drop_repeated_passages`` starts a window at every line instead and
finds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import durable
from .shared import text_of

DIVISOR = 3
FACTOR = 31
MIN_LINES = 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(texts: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Adds ``chunks``: array of (n_lines, text) that join to the text again with line feeds."""
    df = texts.withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("hashes", F.transform("lines", line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("hashes", F.lit(1), F.size("hashes") - 1))
    df = df.withColumn("rolling", F.zip_with("hashes", before, lambda h, b: F.pmod(h + FACTOR * b, F.lit(divisor))))
    last = F.size("lines") - 1
    places = F.sequence(F.lit(0), last)
    ends = F.transform(
        F.filter(F.arrays_zip(places.alias("i"), F.col("rolling").alias("r")), lambda x: (x["r"] == 0) | (x["i"] == last)),
        lambda x: x["i"],
    )
    df = df.withColumn("ends", ends)
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))
    chunk = lambda s, e: F.struct(
        (e - s + 1).alias("n_lines"), F.array_join(F.slice(F.col("lines"), s + 1, e - s + 1), "\n").alias("text")
    )
    return df.withColumn("chunks", F.zip_with(starts, "ends", chunk)).drop("hashes", "rolling", "ends")


def _occurrences(docs: DataFrame, min_lines: int, divisor: int) -> DataFrame:
    """doc_id, text_key, pos, chunk_key, chunk: one row per chunk of ``min_lines`` lines or more."""
    # the outer form, though no array is empty: before the other one Spark tests the array's size, and so cuts every text twice
    cut = with_chunks(docs, divisor).select("doc_id", "text_key", F.posexplode_outer("chunks").alias("pos", "c"))
    long_enough = cut.filter(F.col("c.n_lines") >= min_lines)
    return long_enough.select("doc_id", "text_key", "pos", F.md5(F.col("c.text").cast("binary")).alias("chunk_key"), F.col("c.text").alias("chunk"))


def drop_repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, n_lines, removed_lines, text: every document without the chunks that occur earlier in the corpus.

    Input: doc_id, text; other columns are ignored. Earlier is by doc_id (a row without one comes first), then by place in the
    text. A null text is one empty line. Rows that repeat a doc_id with the same text are one place of their chunks and
    get the same result each. A text that is nothing but repeated chunks becomes empty. An empty table gives an empty result.

    Keys of all chunks are counted first, combined before the shuffle; chunks whose key repeats are grouped by their
    bytes, which are sent once, so equal keys of different chunks never remove anything. A chunk that a third of all
    documents hold is one row of the owners' table, which is written before the join, so that Spark can split the hot key.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    found = _occurrences(rows, min_lines, divisor)
    repeated = durable(found.groupBy("chunk_key").count().filter("count > 1").select("chunk_key"))
    suspects = found.join(repeated, "chunk_key")
    place = F.struct("doc_id", "text_key", "pos")
    owned = F.min(place).alias("owner"), F.count(F.lit(1)).alias("copies")
    grouped = durable(suspects.groupBy("chunk_key", "chunk").agg(*owned).drop("chunk"))
    # a key of one chunk names its bytes, so the places need not bring theirs
    kinds = grouped.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("kinds"), F.first("owner").alias("owner"), F.first("copies").alias("copies"))
    owners = durable(kinds.filter("kinds = 1 AND copies > 1").select("chunk_key", "owner"))
    later = found.drop("chunk").join(owners, "chunk_key").select("doc_id", "text_key", "pos", "owner")
    mixed = durable(kinds.filter("kinds > 1").select("chunk_key"))
    if not mixed.isEmpty():
        unlike = found.join(mixed, "chunk_key")
        firsts = unlike.groupBy("chunk_key", "chunk").agg(*owned).filter("copies > 1").drop("copies")
        later = later.unionByName(unlike.join(firsts, ["chunk_key", "chunk"]).select("doc_id", "text_key", "pos", "owner"))
    removed = (
        later.filter(~F.col("owner").eqNullSafe(place))
        .groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = rows.join(removed, rows["doc_id"].eqNullSafe(removed["r_id"]) & (rows["text_key"] == removed["r_key"]), "left")
    cut = with_chunks(joined.select("doc_id", "text", "gone"), divisor)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    cut = cut.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), gone))
    cut = cut.withColumn("left", F.transform("kept", lambda i: F.get(F.col("chunks"), i)))
    kept_lines = F.aggregate("left", F.lit(0), lambda n, c: n + c["n_lines"])
    n_lines = F.size("lines")
    return cut.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        (n_lines - kept_lines).cast("long").alias("removed_lines"),
        F.array_join(F.col("left.text"), "\n").alias("text"),
    )


def _windows(rows: DataFrame) -> DataFrame:
    """Adds ``lines`` and ``windows``: array of (pos, last, text) from each line that is not blank to the next one that is not."""
    df = rows.withColumn("lines", F.split("text", "\n", -1))
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.trim(F.get(F.col("lines"), i)) != "")
    df = df.withColumn("full", full)
    window = lambda i, j: F.struct(
        i.alias("pos"), j.alias("last"), F.array_join(F.slice(F.col("lines"), i + 1, j - i + 1), "\n").alias("text")
    )
    firsts = F.slice("full", F.lit(1), F.greatest(F.size("full") - 1, F.lit(0)))
    return df.withColumn("windows", F.zip_with(firsts, F.slice("full", 2, F.size("full")), window)).filter(F.size("full") > 1).drop("full")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed_lines, text: every document without the runs of two lines or more that occur earlier in the corpus.

    Input, order of places, null texts and repeated rows as in ``drop_repeated_chunks``. A window is a line that is not blank, the
    next one that is not, and the blank ones between. A line goes if a window that holds it occurs at an earlier place, so a
    repeated run goes whole, whatever stands before and behind it, and each line that goes still stands at an earlier place.

    As with chunks, keys of all windows are counted first, and only windows whose key repeats send their bytes and are
    grouped by them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    cut = _windows(rows).select("doc_id", "text_key", F.explode_outer("windows").alias("w"))
    found = cut.select("doc_id", "text_key", "w.pos", "w.last", F.md5(F.col("w.text").cast("binary")).alias("window_key"), F.col("w.text").alias("window"))
    repeated = durable(found.groupBy("window_key").count().filter("count > 1").select("window_key"))
    suspects = found.join(repeated, "window_key")
    place = F.struct("doc_id", "text_key", "pos")
    owners = durable(
        suspects.groupBy("window_key", "window").agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    )
    removed = (
        suspects.join(owners, ["window_key", "window"])
        .filter(~F.col("owner").eqNullSafe(place))
        .groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
        .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", "last")))).alias("gone"))
    )
    joined = rows.join(removed, rows["doc_id"].eqNullSafe(removed["r_id"]) & (rows["text_key"] == removed["r_key"]), "left")
    split = joined.withColumn("lines", F.split("text", "\n", -1))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    split = split.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone))
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("removed_lines"),
        F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n").alias("text"),
    )
