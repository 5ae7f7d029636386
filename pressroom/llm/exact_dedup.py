"""Exact dedup by Patricia tries.

Every input task puts its texts into a compressed radix trie, whose terminal nodes hold the identifier that stays and the number
of copies, and so sends each of its texts once. Those meet by length and content hash, where a second trie compares
whole byte strings. A trie that outgrows its budget is sent on by its largest subtree first and goes on empty there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructType

from .shared import Texts, fresh, text_of

BUDGET = 32 * 1024 * 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# beside its label, a node takes about this many bytes
NODE = 300
CONTENT_KEY = StructType().add("length", LongType()).add("sha", StringType())


class Node:
    __slots__ = ("label", "children", "owner", "copies")

    def __init__(self, label: bytes, owner: int | None = None, copies: int = 0):
        self.label, self.owner, self.copies = label, owner, copies
        self.children: dict[int, Node] = {}


class PatriciaTrie:
    """A radix trie over byte strings in which a node without a terminal has two children at least."""

    def __init__(self, keep: str = "max"):
        self.better = max if keep == "max" else min
        self.root = Node(b"")
        self.sizes: dict[int, int] = {}
        self.size = 0

    def insert(self, key: bytes, owner: int | None, copies: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner, copies)
                grown = end - at + NODE
                self.sizes[key[0]] = self.sizes.get(key[0], 0) + grown
                self.size += grown
                return
            if not key.startswith(child.label, at):
                child = self._split(node, child, key, at)
            node, at = child, at + len(child.label)
        known = [x for x in (node.owner, owner) if x is not None]
        node.owner, node.copies = self.better(known, default=None), node.copies + copies

    def _split(self, parent: Node, child: Node, key: bytes, at: int) -> Node:
        """A node for what the child's label and the key have in common, found by halving."""
        low, high = 1, len(child.label)
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if key.startswith(child.label[low:mid], at + low) else (low, mid)
        upper = Node(child.label[:low])
        child.label = child.label[low:]
        upper.children[child.label[0]] = child
        parent.children[key[at]] = upper
        return upper

    def terminals(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """(key, owner, copies), of one subtree of the root if ``first`` is given."""
        todo = [(b"", self.root if first is None else self.root.children[first])]
        while todo:
            before, node = todo.pop()
            key = before + node.label
            if node.copies:
                yield key, node.owner, node.copies
            todo.extend((key, c) for c in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Gives the largest subtree away."""
        first = max(self.sizes, key=self.sizes.__getitem__)
        yield from self.terminals(first)
        del self.root.children[first]
        self.size -= self.sizes.pop(first)


def _text_batch(rows: list[tuple[bytes, int | None, int]]) -> pa.RecordBatch:
    keys = [r[0] for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([len(k) for k in keys], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string()),
            pa.array(keys, pa.binary()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        ["length", "sha", "key", "owner", "copies"],
    )


def _batched(rows: Iterator[tuple[bytes, int | None, int]], limit: int = 8 * 1024 * 1024) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 100
        if size >= limit:
            yield _text_batch(held)
            held, size = [], 0
    if held:
        yield _text_batch(held)


def _local_tries(keep: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(keep)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(text.as_py().encode().translate(LOWER), doc_id)
                while trie.size > budget:
                    yield from _batched(trie.spill())
        yield from _batched(trie.terminals())

    return run


def _owner_tries(keep: str):
    """Rows come sorted by length and hash, so one trie at a time is held: the byte strings of one length and hash."""

    def close(length: int, sha: str, trie: PatriciaTrie) -> tuple[int, str, int | None, int]:
        ends = list(trie.terminals())
        if len(ends) > 1:
            raise ValueError(f"different texts of {length} bytes have the SHA-256 {sha}")
        return length, sha, ends[0][1], ends[0][2]

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["length", "sha", "keep_id", "group_size"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, None
        for batch in batches:
            out = []
            lengths, shas, owners, copies = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, key in enumerate(batch.column(2)):
                if (lengths[i], shas[i]) != at:
                    if trie is not None:
                        out.append(close(*at, trie))
                    at, trie = (lengths[i], shas[i]), PatriciaTrie(keep)
                trie.insert(key.as_py(), owners[i], copies[i])
            yield batch_of(out)
        if trie is not None:
            yield batch_of([close(*at, trie)])

    return run


@arrow_udf(CONTENT_KEY)
def content_key(texts: pa.Array) -> pa.Array:
    lengths, shas = [], []
    for t in Texts(texts):
        key = (t or "").encode().translate(LOWER)
        lengths.append(len(key))
        shas.append(hashlib.sha256(key).hexdigest())
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(shas, pa.string())], ["length", "sha"])


def text_owners(docs: DataFrame, keep: str = "max", budget: int = BUDGET) -> DataFrame:
    """length, sha, keep_id, group_size: one row per text, equal when identical after lower-casing A to Z."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    local = rows.mapInArrow(_local_tries(keep, budget), "length long, sha string, key binary, owner long, copies long")
    met = local.repartition("length", "sha").sortWithinPartitions("length", "sha")
    return met.mapInArrow(_owner_tries(keep), "length long, sha string, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "max", budget: int = BUDGET, every_row: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too.

    Input: doc_id, text; other columns are ignored. A null text is empty. ``keep`` says whether the largest or the smallest doc_id
    of equal texts stays; a null doc_id stays only where all are null. Rows that repeat a doc_id with an equal text count each
    in ``group_size``; they are one document and come out once, or each with ``every_row``. An empty table gives an empty result.

    Texts travel once per task and distinct text. A text that a third of all documents share is one owner row, which the
    documents' rows, without their texts, meet in a join that Spark can split.
    """
    owners = text_owners(docs, keep, budget)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(text_of()).alias("k"))
    rows = rows.select("doc_id", F.col("k.length").alias("length"), F.col("k.sha").alias("sha"))
    rows = rows if every_row else rows.distinct()
    # null-safe, or Spark would test the keys for nulls before the join and so work them out twice
    same = rows["length"].eqNullSafe(owners["length"]) & rows["sha"].eqNullSafe(owners["sha"])
    joined = rows.hint("merge").join(owners, same)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), rows["sha"].alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, keep: str = "max", budget: int = BUDGET) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat a doc_id with an equal text, one."""
    stay = exact_groups(docs, keep, budget).filter("kept")
    key, = fresh(docs, "key")
    keyed = docs.withColumn(key, content_key(text_of())["sha"])
    same = keyed[key].eqNullSafe(stay["text_sha256"]) & keyed["doc_id"].cast("long").eqNullSafe(stay["doc_id"])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)

