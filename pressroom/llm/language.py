"""Language by prediction by partial matching: one tree of byte contexts per language, scored by exact code lengths.

A context is what stands before a byte, up to ``ORDER`` bytes, and is a node where it was seen often enough, so its order varies. A node that saw ``n`` bytes, ``d``
different ones, gives a byte that it saw ``k`` times the probability k / (n + d) and keeps d / (n + d) for an escape to the next shorter context, whose
probabilities of the bytes not yet seen fill it in proportion. The empty context escapes to all 256 bytes alike. So the probabilities of a context always sum to 1, and their negative
logarithms are code lengths. The counts are frozen after training, so the code length of a byte depends on the bytes before it only and whole texts are scored with array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import durable
from .shared import remainder, text_of

SAMPLE_PER_LANGUAGE = 1000
SAMPLE_ROWS = 40_000
SAMPLE_BYTES = 65_536
SHARES = 64
ORDER = 4
LEAST_SEEN = 12
MAX_CONTEXTS = 16_000
# of the arrays that go to each Python worker
MODEL_BYTES = 32_000_000
SLICE = 1 << 17
UNDETERMINED = "und"


@dataclass
class ContextTrees:
    """The trees of all languages over one set of contexts.

    ``symbol`` maps a byte to its number; bytes never seen share the last one. ``child`` leads from a context to the one that is a byte longer at its
    front; node 0 is nowhere, node 1 the empty context. ``bits`` holds per context, byte and language the code length.
    """

    langs: list[str]
    symbol: np.ndarray
    child: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a whole text, per language."""
        total = np.zeros(len(self.langs))
        codes = np.frombuffer(data, np.uint8)
        for at in range(0, len(codes), SLICE):
            total += self._bits_of(codes[max(0, at - ORDER) : at + SLICE], min(at, ORDER)).sum(0, dtype=float)
        return total

    def _bits_of(self, codes: np.ndarray, skip: int) -> np.ndarray:
        """Bits per byte after the first ``skip`` bytes, which are context only."""
        symbols = self.symbol[codes]
        width = self.child.shape[1]
        flat = self.child.reshape(-1)
        node = np.ones(len(symbols), np.int32)
        at = node.copy()
        for back in range(1, min(ORDER, len(symbols)) + 1):
            at[:back] = 0
            at[back:] = flat[at[back:] * width + symbols[: len(symbols) - back]]
            np.copyto(node, at, where=at > 0)
        return self.bits.reshape(-1, len(self.langs)).take(node[skip:] * width + symbols[skip:], axis=0)


# ---- training


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, byte), contexts of every order up to ``ORDER``, per language. A context is its bytes read as a number, the last one lowest."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            held: list[bytes] = []
            for text in [*(t for name, t in zip(langs, texts, strict=True) if name == lang), None]:
                if held and (text is None or sum(map(len, held)) + len(text) > SLICE * 8):
                    yield from _grams_of(lang, held)
                    held = []
                held.append(text)


def _grams_of(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.array(list(map(len, texts)))
    # bytes of the text that stand before each byte
    before = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = codes.copy()
    for order in range(ORDER + 1):
        if order:
            gram[order:] |= codes[: len(codes) - order] << (8 * order)
        found, n = np.unique(gram[before >= order], return_counts=True)
        size = len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([order] * size, pa.int32()), pa.array(found >> 8), pa.array((found & 255).astype(np.int32)), pa.array(n)],
            ["lang", "ord", "context", "byte", "n"],
        )


def trees_of(lang: np.ndarray, order: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> ContextTrees:
    """The trees for the counts of each byte after each kept context. With a context its shorter ones must be there."""
    langs = sorted(set(lang.tolist()), key=str.encode)
    code = {name: i for i, name in enumerate(langs)}
    lang = np.array([code[name] for name in lang.tolist()], np.int64)
    seen_bytes = np.unique(byte)
    symbol = np.full(256, len(seen_bytes), np.int32)
    symbol[seen_bytes] = np.arange(len(seen_bytes))
    width, unseen = len(seen_bytes) + 1, 256 - len(seen_bytes)

    # node 1 is the empty context; shorter contexts have smaller numbers
    keys, node_of = np.unique((order.astype(np.int64) << 40) | context, return_inverse=True)
    number = {int(k): i + 1 for i, k in enumerate(keys)}
    child = np.zeros((len(keys) + 1, width), np.int32)
    parent = np.zeros(len(keys) + 1, np.int64)
    for key, node in number.items():
        depth, value = key >> 40, key & ((1 << 40) - 1)
        if depth:
            front = value >> (8 * (depth - 1))
            parent[node] = number[((depth - 1) << 40) | (value & ((1 << 8 * (depth - 1)) - 1))]
            child[parent[node], symbol[front]] = node

    seen = np.zeros((len(keys) + 1, width, len(langs)))
    np.add.at(seen, (node_of + 1, symbol[byte], lang), n)
    chance = np.full((len(keys) + 1, width, len(langs)), 1 / 256)
    # the last symbol stands for each of the bytes never seen
    many = np.ones((width, 1))
    many[-1] = unseen
    for node in range(1, len(keys) + 1):
        total, different = seen[node].sum(0), (seen[node] > 0).sum(0)
        base = chance[parent[node]]
        rest = np.where(seen[node] > 0, 0, base)
        room = (rest * many).sum(0)
        # a language that never saw the context takes the shorter one's chances; one that saw every byte there has nothing to escape to
        kept = np.where(room > 0, different, 0)
        escape = np.where(total == 0, 1.0, kept / np.maximum(total + kept, 1))
        chance[node] = np.where(seen[node] > 0, seen[node] / np.maximum(total + kept, 1), rest * escape / np.where(room > 0, room, 1))
    # where no byte is left unseen, the last symbol never occurs
    return ContextTrees(langs, symbol, child, -np.log2(np.maximum(chance, 1e-300)).astype(np.float32))


def train(
    docs: DataFrame,
    holdout: tuple[int, int] = (4, 2),
    per_language: int = SAMPLE_PER_LANGUAGE,
    sample_rows: int = SAMPLE_ROWS,
    max_bytes: int = SAMPLE_BYTES,
    max_contexts: int = MAX_CONTEXTS,
    model_bytes: int = MODEL_BYTES,
) -> ContextTrees | None:
    """Trees from at most ``per_language`` rows of each language and ``sample_rows`` in all, none of the held-out fold, chosen by hash and so alike in every run.

    Texts of over ``max_bytes`` bytes are not chosen. Spark sums the byte runs of the sample and picks the contexts: those that some language saw ``LEAST_SEEN`` times, the largest share of a
    language first, as many as ``max_contexts`` and ``model_bytes`` allow. Their counts come to the driver. None where no row can be learned from.
    """
    modulus, out = holdout
    doc_id = F.col("doc_id").cast("long")
    known = docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().cast("binary").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != out))
    known = known.filter(F.octet_length("text").between(1, max_bytes)).withColumn("digest", F.xxhash64("text"))
    # chosen by key, so no text is shuffled; sample_rows triples at most are broadcast, taken in turn from all languages
    chosen = known.select("lang", "doc_id", "digest", F.pmod(F.hash("doc_id"), F.lit(SHARES)).alias("share"))
    # a language is thinned in shares first, so that what meets in one task does not grow with the tasks
    for keys in (["lang", "share"], ["lang"]):
        place = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
        chosen = chosen.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_language)
    chosen = chosen.orderBy("place", "lang").limit(sample_rows).select("lang", "doc_id", "digest").distinct()
    sample = known.join(F.broadcast(chosen), ["lang", "doc_id", "digest"], "left_semi").select("lang", "text")
    counted = sample.mapInArrow(_grams, "lang string, ord int, context long, byte int, n long")
    grams = durable(counted.groupBy("lang", "ord", "context", "byte").agg(F.sum("n").alias("n")))

    single = grams.filter("ord = 0").groupBy("lang").agg(F.sum("n").alias("size"))
    facts = grams.filter("ord = 0").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("byte").alias("bytes")).first()
    if not facts["langs"]:
        return None
    fit = model_bytes // ((facts["bytes"] + 1) * 4 * (facts["langs"] + 1))
    seen = grams.filter("ord > 0").groupBy("lang", "ord", "context").agg(F.sum("n").alias("n")).join(single, "lang")
    worth = seen.groupBy("ord", "context").agg(F.max("n").alias("most"), F.max(F.col("n") / F.col("size")).alias("worth")).filter(F.col("most") >= LEAST_SEEN)
    # a shorter context is seen wherever a longer one is, so it comes no later in this order
    kept = worth.orderBy(F.desc("worth"), "ord", "context").limit(max(1, min(max_contexts, fit))).select("ord", "context")
    both = grams.filter("ord = 0").unionByName(grams.join(F.broadcast(kept), ["ord", "context"], "left_semi").select(*grams.columns))
    table = both.toArrow()
    return trees_of(*(table.column(c).to_numpy() for c in ("lang", "ord", "context", "byte", "n")))


# ---- prediction


def predict(docs: DataFrame, holdout: tuple[int, int] = (4, 2), per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    Input: doc_id, text, lang; other columns are ignored and ``lang`` is read for training only. A null text, or one without a letter, is ``und`` with score 0, and so is
    every text where nothing could be learned. Else ``lang_pred`` is the language whose tree gives the whole text the shortest code, the first by its bytes on a tie, and ``score`` its share of the
    probability that all trees give it. A row without doc_id is not held out and teaches nothing. Rows are scored where they lie, without a shuffle; an empty table gives an empty result.
    """
    trees = train(docs, holdout, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text, letters in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if not letters or trees is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                length = trees.code_lengths(text.as_buffer())
                best = int(length.argmin())
                names.append(trees.langs[best])
                scores.append(float(1 / np.exp2(np.minimum(length[best] - length, 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), (remainder(doc_id, holdout[0]) == holdout[1]).alias("held_out"), text_of().cast("binary").alias("text"), text_of().rlike(r"\p{L}").alias("letters")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
