"""Quality by a factorisation machine over hashed words, structure statistics and length.

Each feature has a weight and a short vector; a pair of features counts the product of their values times the dot product of their
vectors. The sum over all pairs is half of (sum of v x) squared less the sum of (v x) squared, so a text is scored in time linear in
its features. Statistics are cut into quantile bins, one feature per bin.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import Remembered, Texts, fresh, labelled_sample, remainder, text_of
from .toxicity import isotonic, scorer

SAMPLE_ROWS = 12_000
HASHED = 8192
BINS = 12
RANK = 8
STAT_VALUE = 0.4
STATS = 15


class Hashes(Remembered):
    """Hash of each word."""

    def work_out(self, word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "replace")) % HASHED


HASHES = Hashes()
SIGNS = np.array([33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in range(128)])


def describe(text: str) -> tuple[np.ndarray, list[float]]:
    """Hashed words of a whole text, and its statistics: lengths, capitals, digits, signs, repetition, lines."""
    words = text.lower().split()
    distinct = set(words)
    n, chars = max(1, len(words)), max(1, len(text))
    codes = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(codes, minlength=256)
    capitals, small, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    signs = SIGNS[np.minimum(codes, 127)]
    together = signs[1:] & signs[:-1]
    runs = np.count_nonzero(together[1:] & ~together[:-1]) + (len(together) and int(together[0]))
    lines = text.split("\n")
    stats = [
        math.log1p(len(words)),
        len(text) / n,
        capitals / max(1, capitals + small),
        digits / chars,
        np.count_nonzero(signs) / chars,
        np.count_nonzero(together) / chars,
        runs / n,
        (count[46] + count[44]) / n,
        len(distinct) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        len(lines) / n,
        len(set(lines)) / len(lines),
        max(map(len, distinct), default=0) / n,
        count[128:].sum() / chars,
    ]
    hashed = np.fromiter(map(HASHES.__getitem__, distinct), np.uint16, len(distinct))
    return np.unique(hashed), [float(s) for s in stats]


@dataclass
class FactorMachine:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def indices(self, words: np.ndarray, stats: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = [HASHED + j * BINS + int(np.searchsorted(e, s, side="right")) for j, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        index = np.concatenate([words.astype(np.int64), np.array(bins, np.int64)])
        value = np.full(len(index), STAT_VALUE)
        value[: len(words)] = 1 / math.sqrt(max(1, len(words)))
        return index, value

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        return self.base + float(self.w[index] @ value) + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.base)
        m = np.array([self.margin(*self.indices(*describe(t or ""))) for t in texts], float)
        return 0.99 * np.interp(m, *self.steps) + 0.01 / (1 + np.exp(-m))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, edges: list[np.ndarray], epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> FactorMachine:
    """Logistic loss by mini-batches with AdaGrad steps; the seed is fixed, so equal rows give an equal model."""
    draw = np.random.default_rng(8)
    size = HASHED + STATS * BINS
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = FactorMachine(math.log(share / (1 - share)), edges, np.zeros(size), draw.normal(0, 0.05, (size, RANK)))
    gw, gv = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            counts = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            doc = np.repeat(np.arange(len(chosen)), counts)
            vx = model.v[index] * value[:, None]
            sums = np.add.reduceat(vx, starts)
            pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
            margin = model.base + np.add.reduceat(model.w[index] * value, starts) + pairs
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[chosen]) / len(chosen)
            step = error[doc] * value
            touched, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, step) + decay * model.w[touched]
            dv = np.stack([np.bincount(inverse, step * (sums[doc, k] - vx[:, k])) for k in range(RANK)], 1) + decay * model.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            model.w[touched] -= rate * dw / np.sqrt(gw[touched])
            model.v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
    return model


def train(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (3, 1), rows: int = SAMPLE_ROWS, label: str = "quality") -> FactorMachine:
    """Learns from at most ``rows`` labelled documents outside the held-out fold.

    To the driver come, per document, its hashed words (16 KB at most, as there are ``HASHED`` of 2 bytes) and its statistics. A fifth of them
    calibrates the margins. With no usable label every score is 1, so nothing is rejected; with labels of one kind only, that label.
    """

    @arrow_udf("struct<words: binary, stats: array<double>>")
    def described(texts: pa.Array) -> pa.Array:
        found = [(w.tobytes(), s) for w, s in map(describe, Texts(texts))]
        columns = [pa.array([w for w, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["words", "stats"])

    sample = labelled_sample(docs, labels, label, holdout, rows)
    table = sample.select("doc_id", "label", described("text").alias("d")).groupBy("doc_id").agg(F.min(F.struct("label", "d")).alias("r"))
    got = table.select("doc_id", "r.label", "r.d.words", "r.d.stats").orderBy("doc_id").toPandas()
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return FactorMachine(float(y[0]) if len(y) else 1.0)
    stats = np.stack(got["stats"].to_numpy()).astype(float)
    aside = (got["doc_id"].to_numpy() * 2654435761 % 2**32 % 5) == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 5 or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    edges = [np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(STATS)]
    shape = FactorMachine(0.0, edges)
    indexed = [shape.indices(np.frombuffer(w, np.uint16), s) for w, s in zip(got["words"], stats, strict=True)]
    inside = np.flatnonzero(~aside)
    model = fit([indexed[i] for i in inside], y[inside], edges)
    checked = np.flatnonzero(aside) if aside.any() else inside
    model.steps = isotonic(np.array([model.margin(*indexed[i]) for i in checked]), y[checked])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (3, 1), rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Input: docs with doc_id and text, labels with doc_id and quality; other columns are ignored, and no score uses more than the text.
    A document is held out when CRC32 of its doc_id as text leaves ``holdout[1]`` modulo ``holdout[0]``; a row without doc_id is not, and
    has no label. A null text is empty. Whole texts are read, in the rows' own tasks. An empty table gives an empty result.
    """
    score = scorer(train(docs, labels, holdout, rows))
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), holdout[0]) == holdout[1]).alias("held_out"), score(text_of()).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (3, 1), rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    name, = fresh(docs, "score")
    scored = docs.withColumn(name, scorer(train(docs, labels, holdout, rows))(text_of()))
    return scored.filter(F.col(name) >= 0.5).drop(name)
