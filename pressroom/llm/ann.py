"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row goes down to its leaf. A query opens nodes from a priority queue, best centre first,
until it has visited a number of leaves, which is widened until queries of a calibration sample find the asked share of their
true neighbours. A query is compared with the rows of the leaves that it opened and no others. Small leaves side by side travel in one block, a leaf that holds a
third of all rows is cut into many, so a block has a bounded size, and a query sends on ``k`` rows per block and not per leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import durable

SAMPLE_ROWS = 20_000
LEAF_ROWS = 400
BRANCHES = 8
CALIBRATION = 64
RECALL = 0.96
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048


@dataclass
class Tree:
    """Nodes by number, root 0: the centres of their children, the children's numbers, and the leaf's number or -1."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaf: list[int]
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = _nearest(x[rows], self.centres[node])
            todo.extend((child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any())
        return out

    def best_bins(self, query: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best inner product with a node's centre first, and more until they hold ``least`` rows by ``counts``."""
        out: list[int] = []
        queue = [(-np.inf, 0)]
        held = 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += 0 if counts is None else int(counts[self.leaf[node]])
            else:
                for product, child in zip(self.centres[node] @ query, self.children[node], strict=True):
                    heapq.heappush(queue, (-float(product), child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, steps: int = 12) -> Tree:
    """K-means of ``branches`` centres, again in each cluster, until it has ``leaf_rows`` rows or can't be cut."""
    draw = np.random.default_rng(9)
    tree = Tree([], [], [], 0)

    def add() -> int:
        tree.centres.append(np.empty((0, x.shape[1])))
        tree.children.append([])
        tree.leaf.append(-1)
        return len(tree.leaf) - 1

    todo = [(add(), x)]
    while todo:
        node, rows = todo.pop()
        different = np.unique(rows, axis=0) if len(rows) > leaf_rows else rows[:1]
        if len(different) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        centres = different[draw.choice(len(different), min(branches, len(different)), replace=False)]
        for _ in range(steps):
            at = _nearest(rows, centres)
            counts = np.bincount(at, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, at, rows)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        at = _nearest(rows, centres)
        used = [k for k in range(len(centres)) if (at == k).any()]
        if len(used) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        tree.centres[node] = centres[used]
        for k in used:
            child = add()
            tree.children[node].append(child)
            todo.append((child, rows[at == k]))
    return tree


# ---- exact products


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order, so equal vectors have equal products."""
    return (queries * rows).sum(-1)


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of each query's best ``k`` rows but its own, ties to the smaller identifier."""
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    for at in range(0, len(queries), 256):
        q, q_ids = queries[at : at + 256], query_ids[at : at + 256]
        rough = q @ rows.T
        rough[q_ids[:, None] == ids[None, :]] = -np.inf
        if k < len(ids):
            last = -np.partition(-rough, k - 1, 1)[:, k - 1]
            # rough products err by some units in the last place; whatever may be in the first k is worked out again
            slack = 1e-12 * (1 + np.linalg.norm(q, axis=1) * (np.linalg.norm(rows, axis=1).max()))
            keep = (rough >= np.where(np.isfinite(last), last - slack, -np.inf)[:, None]) & np.isfinite(rough)
        else:
            keep = np.isfinite(rough)
        a, b = np.nonzero(keep)
        score = products(q[a], rows[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        near = nth < k
        found.append((a[near] + at, by_id[b[near]], score[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def opened_only(
    query_ids: np.ndarray, queries: np.ndarray, opened: np.ndarray, n_opened: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`top` over the leaves that each query has opened, and no others: a leaf's rows meet the queries that opened it."""
    query = np.repeat(np.arange(len(queries)), n_opened)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    by_leaf, by_opened = np.argsort(leaf, kind="stable"), np.argsort(opened, kind="stable")
    for number in np.unique(leaf):
        r = by_leaf[np.searchsorted(leaf[by_leaf], number) : np.searchsorted(leaf[by_leaf], number, side="right")]
        q = query[by_opened[np.searchsorted(opened[by_opened], number) : np.searchsorted(opened[by_opened], number, side="right")]]
        if len(q):
            a, b, score = top(query_ids[q], queries[q], ids[r], rows[r], k)
            found.append((q[a], r[b], score))
    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    near = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[near], b[near], score[near]


# ---- the operator


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.assign(x)), packed], ["vec_id", "leaf", "v"])

    return rows.mapInArrow(run, "vec_id long, leaf int, v binary")


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _calibrate(index: DataFrame, tree: Tree, sample: list[tuple[int, bytes]], k: int, recall: float) -> int:
    """The number of leaves that the sample's queries must visit: doubled, then halved between, until they find the share ``recall``."""
    q_ids = np.array([s[0] for s in sample])
    q = np.stack([np.frombuffer(s[1], float) for s in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, score = top(q_ids, q, batch.column(0).to_numpy(), _unpacked(batch.column(2)), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[a]), batch.column(0).take(pa.array(b)), batch.column(1).take(pa.array(b)), pa.array(score)],
                    ["query_id", "vec_id", "leaf", "score"],
                )

    nearest = _best(index.mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k).select("query_id", "leaf").collect()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.best_bins(v, tree.leaves))} for i, v in zip(q_ids, q, strict=True)}
    needed = np.array([place[r["query_id"]][r["leaf"]] + 1 for r in nearest])
    visits = 1
    while visits < tree.leaves and len(needed) and (needed <= visits).mean() < recall:
        visits *= 2
    low = visits // 2
    while low + 1 < visits:
        mid = (low + visits) // 2
        low, visits = (low, mid) if (needed <= mid).mean() >= recall else (mid, visits)
    return max(1, min(visits, tree.leaves))


def blocks_of_leaves(counts: list[int], block_rows: int) -> np.ndarray:
    """The block of each leaf: leaves side by side share one while they have ``block_rows`` rows at most together."""
    out, block, held = [], 0, 0
    for n in counts:
        if held and held + n > block_rows:
            block, held = block + 1, 0
        held += n
        out.append(block)
    return np.array(out, np.int32)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Rank within the query; Spark keeps ``k`` rows per query and task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for every row that ``queries`` (a condition on vec_id) chooses.

    Input: vec_id, embedding; other columns are ignored. Rows without vec_id, and vectors that are null, empty, zero or hold a null or
    a number that is not finite, take no part; nor do vectors of another length than most. Of rows that share a vec_id the largest
    vector counts. Ties go to the smaller vec_id. A query never finds itself; a query visits the calibrated
    number of leaves and goes on until they hold ``k`` other rows, so it finds fewer only where there are fewer. An
    empty table gives an empty result.

    Bounded, whatever the input: the sample of ``sample_rows`` vectors that the tree is fitted on and the ``CALIBRATION`` queries come to the driver; the tree
    goes to the tasks. Every row is indexed. Blocks hold ``block_rows`` rows and ``block_queries`` queries at most on average.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == sizes["n"])
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    tree = fit_tree(_matrix(sampled.column("embedding").combine_chunks()))
    index = durable(_assigned(rows, tree))
    asked = index.filter(queries)
    sample = [(r["vec_id"], bytes(r["v"])) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    visits = _calibrate(index, tree, sample, k, recall)

    # one number per leaf, of which there are at most the sample's rows
    found = dict(index.groupBy("leaf").count().collect())
    counts = np.array([found.get(leaf, 0) for leaf in range(tree.leaves)])
    block_of = blocks_of_leaves(counts.tolist(), block_rows)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unpacked(batch.column(2))
            at, blocks, opened = [], [], []
            for i, v in enumerate(q):
                leaves = np.sort(np.array(tree.best_bins(v, visits, counts, k + 1), np.int32))
                # leaves side by side share a block, so the blocks rise with the leaves
                first = np.flatnonzero(np.diff(block_of[leaves], prepend=-1))
                at += [i] * len(first)
                blocks += block_of[leaves[first]].tolist()
                opened += np.split(leaves, first[1:])
            for part in np.array_split(np.arange(len(at)), max(1, len(at) // 20_000)):
                take = pa.array([at[p] for p in part], pa.int64())
                lists = pa.array([opened[p] for p in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array([blocks[p] for p in part], pa.int32()), lists, batch.column(2).take(take)], ["query_id", "block", "opened", "q"]
                )

    visiting = asked.mapInArrow(traverse, "query_id long, block int, opened array<int>, q binary")
    leaves = spark.createDataFrame([(leaf, int(b)) for leaf, b in enumerate(block_of)], "leaf int, block int")
    rows = index.join(F.broadcast(leaves), "leaf")
    n_rows = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("row_blocks"))
    n_asked = visiting.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("query_blocks"))
    blocks = F.broadcast(durable(n_rows.join(n_asked, "block")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, "block").select(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int").alias("rb"), every("query_blocks").alias("qb"), "vec_id", "v", "leaf"
    )
    right = visiting.join(blocks, "block").select(
        "block", every("row_blocks").alias("rb"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb"), "query_id", "q", "opened"
    )

    def compare(candidates: pa.Table, searching: pa.Table) -> pa.Table:
        ids, q_ids = (t.column(3).combine_chunks() for t in (candidates, searching))
        if not len(ids) or not len(q_ids):
            a, b, score = np.empty(0, int), np.empty(0, int), np.empty(0)
        else:
            opened = searching.column(5).combine_chunks()
            a, b, score = opened_only(
                q_ids.to_numpy(), _unpacked(searching.column(4)), opened.flatten().to_numpy(), opened.value_lengths().to_numpy(),
                ids.to_numpy(), _unpacked(candidates.column(4)), candidates.column(5).to_numpy(), k,
            )
        return pa.table({"query_id": q_ids.take(pa.array(a)), "vec_id": ids.take(pa.array(b)), "score": pa.array(score, pa.float64())})

    key = ["block", "rb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
