"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's 64 bits are two halves of 32. Fingerprints that differ in 3 bits at most differ in one bit at most in one of the halves. Per half the
anchors are a covering code: a codeword of the [31, 26] Hamming code, which is within one bit of every 31-bit word, and the 32nd bit as it
is. Each fingerprint has its home at the anchor that covers it and is replicated to every anchor within the covering radius plus the
half's threshold of one bit, about 17 of 2**27; the home of each fingerprint that differs from it by one bit there is among them. Per anchor, homes are compared with visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ..operators.skew import durable
from .shared import fresh, text_of

THRESHOLD = 3
SHINGLE = 3
# homes, and visitors, of one anchor that one group of rows compares
BLOCK = 8192
# pairs held at once while comparing
PAIRS = 2_000_000
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


# ---- fingerprints


def with_hashes(df: DataFrame, words: str, hashes: str) -> DataFrame:
    """Adds the words of ``text``, A to Z in lower case, and XXH64 (seed 42) of each run of ``SHINGLE``; of all words where they are fewer."""
    plain = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trimmed = F.trim(plain, F.lit(" \t\n\x0b\x0c\r"))
    # a column of its own, so that the lambda below reads it and doesn't split again for each word
    df = df.withColumn(words, F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    w = F.col(words)
    few = F.when(F.get(w, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)]))
    )
    return df.withColumn(hashes, F.when(F.size(w) < SHINGLE, few).otherwise(runs))


@arrow_udf(LongType())
def majority(hashes: pa.Array) -> pa.Array:
    """64 bits per list of hashes: bit i is set if it is set in more than half of them; 0 for an empty list."""
    values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.zeros(len(ends), np.uint64)
    start = 0
    for i, end in enumerate(ends.tolist()):
        if end > start:
            seen = np.bincount((values[start:end] + _PLACE).ravel(), minlength=2048).reshape(8, 256)
            ones = (seen @ _BIT_OF_BYTE).ravel()
            out[i] = np.packbits(ones * 2 > end - start, bitorder="little").view("<u8")[0]
            start = end
    return pa.array(out.view(np.int64))


def with_fingerprint(df: DataFrame, name: str) -> DataFrame:
    words, hashes = fresh(df, "words", "hashes")
    return with_hashes(df, words, hashes).withColumn(name, majority(F.col(hashes))).drop(words, hashes)


# ---- anchors


def syndrome(words: np.ndarray) -> np.ndarray:
    """XOR of the places, from 1, of the bits set among the low 31."""
    out = np.zeros(words.shape, np.uint64)
    for place in range(1, 32):
        out ^= ((words >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def _flip(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The word with the bit at ``place`` flipped; as it is where the place is 0."""
    return words ^ ((np.uint64(1) << place) >> np.uint64(1))


def anchors(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, fingerprint, home) arrays: first the homes, then the visits, of each half. An anchor is half, 32nd bit and codeword."""
    one = np.uint64(1)
    for half in (0, 1):
        side = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low, top = side & np.uint64(0x7FFFFFFF), side & np.uint64(0x80000000)
        s = syndrome(low)
        # syndrome 0 is a codeword; the shift below drops the bit of place 0
        home = _flip(low, s)
        at = np.uint64(half) << np.uint64(32)
        yield at | top | home, prints, True
        yield at | (top ^ np.uint64(0x80000000)) | home, prints, False
        # two flips i, j with i xor j = s give the codewords two bits away
        for i in range(1, 32):
            i_ = np.uint64(i)
            j = s ^ i_
            use = (s != 0) & (j > i_)
            if use.any():
                yield at | top[use] | _flip(low[use] ^ (one << (i_ - one)), j[use]), prints[use], False


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for part in np.array_split(prints, max(1, len(prints) // 20_000)):
            found = list(anchors(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
                    pa.array(np.concatenate([f[1] for f in found]).view(np.int64)),
                    pa.array(np.concatenate([np.full(len(f[0]), f[2]) for f in found])),
                ],
                ["anchor", "print", "home"],
            )


# ---- comparing


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) that connect just what a and b connect; at most one per node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def links(cell: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of a home and another row of its cell that differ in ``threshold`` bits at most."""
    order = np.argsort(cell, kind="stable")
    cell, prints, home = cell[order], prints[order], home[order]
    home_cell, home_print = cell[home], prints[home]
    first = np.searchsorted(home_cell, cell, side="left")
    count = np.searchsorted(home_cell, cell, side="right") - first
    rows = np.flatnonzero(count)
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    at, upto = 0, np.cumsum(count[rows])
    while at < len(rows):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        r = rows[at:end]
        n = count[r]
        left = np.repeat(prints[r], n)
        right = home_print[np.repeat(first[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        near = (right < left) & (np.bitwise_count(left ^ right) <= threshold)
        if near.any():
            a, b = forest(np.concatenate([a, left[near]]), np.concatenate([b, right[near]]))
        at = end
    return a, b


def _compare(threshold: int):
    """Rows come sorted by anchor and block; a batch is compared up to its last whole cell and the rest waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def result(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, hb, vb, prints, home = (np.concatenate([p[i] for p in parts]) for i in range(5))
            change = (anchor[1:] != anchor[:-1]) | (hb[1:] != hb[:-1]) | (vb[1:] != vb[:-1])
            a, b = links(np.concatenate([[0], np.cumsum(change)]), prints.view(np.uint64), home, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not batch.num_rows:
                continue
            differs = np.zeros(batch.num_rows, bool)
            for c in columns[:3]:
                differs |= c != c[-1]
            whole = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
            if whole:
                held.append(tuple(c[:whole] for c in columns))
                yield result(held)
                held = []
            held.append(tuple(c[whole:] for c in columns))
        if held:
            yield result(held)

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) that connect just those linked by pairs within ``threshold`` bits.

    An anchor with more than ``block`` rows is cut into blocks of homes and blocks of visitors, each compared with each in a group of its own,
    so no task holds a large anchor and no link is lost. Sizes are counted for all anchors. Per task and batch a forest is sent
    on, not the pairs.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"halves cover up to {THRESHOLD} differing bits")
    cells = prints.mapInArrow(_to_cells, "anchor long, print long, home boolean")
    sizes = cells.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes")).filter(F.col("rows") > block)
    sizes = durable(sizes.select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("hs"), F.ceil(F.col("rows") / block).cast("int").alias("vs")))
    if sizes.isEmpty():
        split = cells.select("anchor", F.lit(0).alias("hb"), F.lit(0).alias("vb"), "print", "home")
    else:
        joined = cells.join(sizes, "anchor", "left").withColumns({"hs": F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1)), "vs": F.coalesce("vs", F.lit(1))})
        own = lambda n: F.pmod(F.xxhash64("print"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        # a home stands in its home block for every block of visitors, and visits as any other row
        as_home = joined.filter("home").select("anchor", own("hs").alias("hb"), F.explode(every("vs")).alias("vb"), "print", "home")
        as_visitor = joined.select("anchor", F.explode(every("hs")).alias("hb"), own("vs").alias("vb"), "print", F.lit(False).alias("home"))
        split = as_home.unionByName(as_visitor)
    met = split.repartition("anchor", "hb", "vb").sortWithinPartitions("anchor", "hb", "vb")
    return met.mapInArrow(_compare(threshold), "a long, b long")


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node that it reaches, by alternating large and small stars.

    A round is a few joins and aggregates that combine before the shuffle; its result is written to the shared checkpoint folder.
    Rounds grow with the logarithm of the longest chain. It ends when a round changes nothing.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = durable(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        found = state(now)
        if found == was:
            break
        was = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    Input: doc_id, text; other columns are ignored. ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id that
    links of ``threshold`` bits reach, the document itself included; a null doc_id counts only where a component has no
    other. A text without words, null included, has the fingerprint zero and is linked like any other. Equal fingerprints are
    linked, and compared once. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(with_fingerprint(texts, "print").select("doc_id", "print"))
    classes = durable(component_of_prints(rows, threshold))
    joined = rows.hint("merge").join(classes, "print")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def component_of_prints(rows: DataFrame, threshold: int = THRESHOLD, first: str = "doc_id") -> DataFrame:
    """(print, component_id) for each distinct fingerprint of ``rows``: the least value of the column ``first`` in its component."""
    smallest = durable(rows.groupBy("print").agg(F.min(first).alias("first")))
    found = components(near_links(smallest.select("print"), threshold))
    rooted = smallest.join(found, smallest["print"] == found["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return rooted.join(least, "root").select("print", "component_id")


def keep_first_of_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows without doc_id come last in their group. Of rows of one doc_id the one with the least digest stays; of rows that repeat doc_id and text,
    one. Fingerprints are worked out once: rows are found again by a digest of doc_id and text, which Spark has an expression for.
    """
    key, = fresh(docs, "key")
    doc_id = F.col("doc_id").cast("long")
    # never null, or Spark would test it for nulls before the join and so work it out twice
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_of())))
    place = F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.col(key).alias("key"))
    rows = durable(with_fingerprint(keyed.select(place.alias("place"), "text"), "print").select("place", "print"))
    first = component_of_prints(rows, threshold, "place").select(F.col("component_id.key").alias(key)).distinct()
    return keyed.hint("merge").join(first, key, "left_semi").dropDuplicates([key]).drop(key)
