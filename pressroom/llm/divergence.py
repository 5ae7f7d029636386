"""Audit of how far the sources of a language differ in their words, by products of one-hot level matrices.

Each language has a matrix with a row per kept term and an indicator column per (source, count level). The matrix times its
own transpose counts, for two columns, the terms that have the one level in the one source and the other level in the other: the joint
tables of all pairs of sources. A price that depends on two levels only is then the sum of a joint table's cells times their prices, whatever the number of
terms. The product is taken in blocks of rows and of columns with whole numbers below 2**24, so single precision holds them exactly.

Level 0 is the complement of a source's other levels, so its columns are not stored: their cells follow by inclusion and exclusion.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of, work_path

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
# (source, term) pairs that a task holds before it sends them on
HELD_TERMS = 400_000
SLICE = 1 << 20
BLOCK_ROWS = 4096
BLOCK_COLUMNS = 1024
# letters as they are, A to Z in lower case, bytes beyond ASCII as they are; the rest separates
TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# ---- counting


def _terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of it at a time."""
    at = 0
    while at < len(data):
        part = data[at : at + SLICE].translate(TERM_BYTES)
        if at + SLICE < len(data):
            cut = part.rfind(b" ") + 1
            if not cut:  # one term longer than a slice
                rest = data[at:].translate(TERM_BYTES)
                cut = rest.find(b" ") + 1 or len(rest)
                part = rest
            part = part[:cut]
        yield part.split()
        at += len(part)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _terms(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n, docs: occurrences and documents of each term in each source. Tasks count before the shuffle."""
    read = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().cast("binary").alias("text"))
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, total, cells: a row per term in ``min_documents`` documents of its language, with its counts by source."""
    rows = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")
    )
    return rows.filter(F.col("docs") >= min_documents).select("lang", "term", "total", "cells")


# ---- the product


def gram_cells(row: np.ndarray, column: np.ndarray, n_rows: int, panel: int = BLOCK_COLUMNS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, count), i <= j: the nonzero cells of X' X, where X is the 0/1 matrix of the given entries. Columns are numbered from 0."""
    width = int(column.max()) + 1 if len(column) else 0

    def dense(start: int) -> np.ndarray:
        x = np.zeros((n_rows, min(panel, width - start)), np.float32)
        use = (column >= start) & (column < start + panel)
        x[row[use], column[use] - start] = 1
        return x

    for a in range(0, width, panel):
        left = dense(a)
        for b in range(a, width, panel):
            product = left.T @ (left if a == b else dense(b))
            i, j = np.nonzero(np.triu(product) if a == b else product)
            yield i + a, j + b, product[i, j].astype(np.int64)


def _blocks(starts: np.ndarray, column: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, columns that occur, place of each entry's column among them): as many rows as keep the columns to a panel."""
    at, last = 0, len(starts) - 1
    while at < last:
        end = min(last, at + BLOCK_ROWS)
        while True:
            used, place = np.unique(column[starts[at] : starts[end]], return_inverse=True)
            if len(used) <= BLOCK_COLUMNS or end == at + 1:
                break
            end = at + max(1, (end - at) // 2)
        yield at, end, used, place
        at = end


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
        for first, end in zip(cuts, cuts[1:]):
            cells = batch.column(1).slice(first, end - first)
            starts = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))])
            flat = cells.flatten()
            names = sorted(set(flat.field(0).to_pylist()), key=str.encode)
            number = {s: i for i, s in enumerate(names)}
            source = np.array([number[s] for s in flat.field(0).to_pylist()], np.int64)
            levels, level = np.unique(flat.field(1).to_numpy(zero_copy_only=False), return_inverse=True)
            columns, column = np.unique(source * len(levels) + level, return_inverse=True)
            pairs, counts = [], []
            for r0, r1, used, place in _blocks(starts, column):
                row = np.repeat(np.arange(r1 - r0), np.diff(starts[r0 : r1 + 1]))
                for i, j, n in gram_cells(row, place, r1 - r0):
                    pairs.append(used[i] * len(columns) + used[j])
                    counts.append(n)
            pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, inverse, np.concatenate(counts))
            name = pa.array(names)
            i, j = columns[pair // len(columns)], columns[pair % len(columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[first]]).take(pa.array(np.zeros(len(pair), np.int64))),
                    name.take(pa.array(i // len(levels))), pa.array(levels[i % len(levels)]),
                    name.take(pa.array(j // len(levels))), pa.array(levels[j % len(levels)]),
                    pa.array(total),
                ],
                ["lang", "source", "level", "other", "other_level", "terms"],
            )


def joint_tables(rows: DataFrame) -> DataFrame:
    """lang, source, level, other, other_level, terms: the terms with these counts, both above 0, in the two sources of a language.

    Each pair of sources comes once, the smaller name first. A source with itself has the counts of its levels. ``rows`` as from :func:`kept_terms`. Terms are
    sorted by their total within each task, so that a block of them has few levels; blocks are summed before the shuffle.
    """
    cells = rows.sortWithinPartitions("lang", "total").select("lang", "cells")
    schema = "lang string, source string, level long, other string, other_level long, terms long"
    keys = ["lang", "source", "level", "other", "other_level"]
    return cells.mapInArrow(_products, schema).groupBy(*keys).agg(F.sum("terms").alias("terms"))


# ---- pricing


def share(level: Column, n: Column, v: Column) -> Column:
    """Smoothed share of a term with ``level`` of ``n`` occurrences, where ``v`` terms count: parts of ``SCALE``, rounded down, plus 1."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (level + 1).cast("decimal(20,0)")).cast("decimal(30,0)")
    return F.when(v > 0, F.floor(F.lit(1) + F.call_function("div", whole, (n + v).cast("decimal(20,0)"))))


def excess(p: Column, q: Column) -> Column:
    """(p - q) squared over q, rounded down."""
    return F.call_function("div", (p - q) * (p - q), q)


def _totals(docs: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """lang, source, n, lang_n, v: occurrences of kept terms in each occurring group and in its language, and the number of kept terms."""
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    of_lang = rows.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    of_group = tables.filter("source = other").groupBy("lang", "source").agg(F.sum(F.col("level") * F.col("terms")).alias("n"))
    joined = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return joined.fillna(0, ["n", "lang_n", "v"]).select("lang", "source", "n", "lang_n", "v")


def pair_values(tables: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, other, value: the price of each ordered pair of sources, summed over all kept terms."""
    side = totals.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n"))
    pairs = totals.select("lang", "source", "n", "v").join(side, "lang").filter("source <> other")
    p0, q0 = share(F.lit(0), F.col("n"), F.col("v")), share(F.lit(0), F.col("other_n"), F.col("v"))
    pairs = pairs.withColumn("p0", p0).withColumn("q0", q0).withColumn("f0", excess(F.col("p0"), F.col("q0")))
    key = ["lang", "source", "other"]
    part = lambda value: [*key, value.cast("decimal(28,0)").alias("part")]
    none = pairs.select(*part(F.coalesce(F.col("v") * F.col("f0"), F.lit(0))))
    levels = tables.filter("source = other").select("lang", "source", "level", "terms")
    p = share(F.col("level"), F.col("n"), F.col("v"))
    one = levels.join(pairs, ["lang", "source"]).select(*part(F.col("terms") * (excess(p, F.col("q0")) - F.col("f0"))))
    q = share(F.col("other_level"), F.col("other_n"), F.col("v"))
    renamed = levels.select("lang", F.col("source").alias("other"), F.col("level").alias("other_level"), "terms")
    other = renamed.join(pairs, ["lang", "other"]).select(*part(F.col("terms") * (excess(F.col("p0"), q) - F.col("f0"))))
    half = tables.filter("source <> other")
    turned = half.select("lang", F.col("other").alias("source"), F.col("other_level").alias("level"), F.col("source").alias("other"), F.col("level").alias("other_level"), "terms")
    met = half.unionByName(turned).join(pairs, key)
    both = met.withColumn("p", p).withColumn("q", q).select(
        *part(F.col("terms") * (excess(F.col("p"), F.col("q")) - excess(F.col("p"), F.col("q0")) - excess(F.col("p0"), F.col("q")) + F.col("f0")))
    )
    every = none.unionByName(one).unionByName(other).unionByName(both)
    return every.groupBy(*key).agg(F.sum("part").cast("long").alias("value"))


def term_values(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, term, value: the price against the whole language of each term that the source has more of."""
    cells = rows.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    priced = cells.withColumnRenamed("n", "level").join(totals, ["lang", "source"])
    priced = priced.withColumn("p", share(F.col("level"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v")))
    more = priced.filter("p > q")
    return more.select("lang", "source", F.col("term").cast("string").alias("term"), excess(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Input: lang, source, text; other columns are ignored and nulls count as empty. Terms are runs of letters A to Z, in lower case, and of characters beyond
    ASCII. A language keeps the terms in ``min_documents`` of its rows. Part ``pair``: ``item`` is each other source, all ranks. Part ``term``: ``item`` is each
    term with a larger share than in the language, to rank ``term_ranks``. Ties go to the item whose UTF-8 bytes are smaller. A source without terms
    has its pairs; a language that keeps none has pairs of value 0. An empty table gives an empty result.

    A task holds ``HELD_TERMS`` terms and those of one document; a row of the matrix has as many cells as its language has sources. All arithmetic is on whole numbers.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, stem: str) -> DataFrame:
        path = work_path(spark, f"divergence-{stem}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = written(kept_terms(term_counts(docs), min_documents), "terms")
    tables = written(joint_tables(rows), "tables")
    totals = written(_totals(docs, rows, tables), "totals")
    pairs = pair_values(tables, totals).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = term_values(rows, totals).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order)
    ranked = terms.withColumn("rank", place).filter(F.col("rank") <= term_ranks)
    return pairs.withColumn("rank", place).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
