"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates over the whole text: hits of a lexicon, their nearness to words of the second person, capitals, punctuation and
spellings that hide a word. The lexicon is a short fixed list and, learned from the training rows by document frequency, words and
word beginnings that toxic documents hold much more often. The trees learn from a bounded sample of labelled rows; a fifth of
it is kept from them and calibrates their margins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import Remembered, Texts, fresh, labelled_sample, remainder, text_of

# Insults and slurs of the mild kind, by language.
INSULTS = {
    "en": "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool imbecile jerk creep filthy vermin".split(),
    "de": "idiot trottel dummkopf abschaum dreckig arschloch blödmann versager widerlich wertlos".split(),
    "fr": "idiot imbécile crétin connard ordure minable stupide dégoûtant abruti pathétique".split(),
    "es": "idiota imbécil estúpido basura asqueroso payaso perdedor escoria patético inútil".split(),
}
# Words of the second person, by language.
SECOND_PERSON = {
    "en": "you your yours yourself u ur".split(),
    "de": "du dich dir dein deine ihr euch euer sie ihnen".split(),
    "fr": "tu te toi ton ta tes vous votre vos".split(),
    "es": "tú te ti tu tus usted ustedes vosotros vuestro".split(),
}
# Signs written for letters.
HIDDEN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

SAMPLE_ROWS = 20_000
LEXICON = 300
PREFIX = 4
NEAR = 5
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_][0-9@$!*._-]+[^\W\d_]")
FEATURES = 15
YOU = frozenset(w for ws in SECOND_PERSON.values() for w in ws)
# what a token of a text can be, as bits
HIT, FIXED, PERSON, SHOUTED, HID, UNCOVERED = 1, 2, 4, 8, 16, 32


@dataclass
class Lexicon:
    """Fixed words, and learned words and word beginnings with their log odds."""

    fixed: frozenset[str] = frozenset(w for ws in INSULTS.values() for w in ws)
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), self.prefixes.get(word[:PREFIX], 0.0))


class Tokens(Remembered):
    """Bits of each token of a text."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def work_out(self, token: str) -> int:
        parts = WORD.findall(token.lower())
        bits = 0
        for p in parts:
            bits |= HIT * (self.lexicon.weight(p) > 0) | FIXED * (p in self.lexicon.fixed) | PERSON * (p in YOU)
        if token.isupper() and sum(map(len, parts)) > 2:
            bits |= SHOUTED
        if len(token) > 2 and MASKED.search(token):
            plain = token.lower().strip(".,;:!?()\"'").translate(HIDDEN)
            bits |= HID | UNCOVERED * (plain in self.lexicon.fixed or self.lexicon.weight(plain) > 0)
        return bits


def features(text: str, tokens: Tokens) -> list[float]:
    """Dense features of a whole text; all 0 for an empty one."""
    words = text.split()
    bits = np.frombuffer(bytes(map(tokens.__getitem__, words)), np.uint8)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = np.flatnonzero(bits & HIT)
    insults = np.flatnonzero(bits & (HIT | FIXED | UNCOVERED))
    people = np.flatnonzero(bits & PERSON)
    near = 0
    if len(people) and len(insults):
        at = np.searchsorted(people, insults)
        left = np.abs(insults - people[np.maximum(at - 1, 0)])
        right = np.abs(people[np.minimum(at, len(people) - 1)] - insults)
        near = int((np.minimum(left, right) <= NEAR).sum())
    found = [p for i in hits for p in WORD.findall(words[i].lower())]
    weights = [w for w in map(tokens.lexicon.weight, found) if w]
    fixed = int(np.count_nonzero(bits & FIXED))
    return [
        math.log1p(len(words)),
        len(hits) / n,
        math.log1p(len(hits)),
        sum(weights) / n,
        max(weights, default=0.0),
        len(set(found)) / n,
        fixed / n,
        math.log1p(fixed),
        near / n,
        len(people) / n,
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / chars,
        np.count_nonzero(bits & SHOUTED) / n,
        (text.count("!") + text.count("?")) / chars,
        np.count_nonzero(bits & HID) / n,
        np.count_nonzero(bits & UNCOVERED) / n,
    ]


def learn_lexicon(sample: DataFrame, size: int = LEXICON, least: float = 2.5) -> Lexicon:
    """Words and word beginnings by smoothed log odds of document frequency. At most ``size`` of each come to the driver."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    units = sample.select(
        "label",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform(words, lambda w: F.concat(F.lit("w"), w)),
                    F.transform(F.filter(words, lambda w: F.char_length(w) > PREFIX), lambda w: F.concat(F.lit("p"), F.substring(w, 1, PREFIX))),
                )
            )
        ).alias("unit"),
    )
    sums = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = sums["n"], sums["toxic"] or 0
    if not toxic or toxic == n:
        return Lexicon()
    inside = F.sum("label")
    counted = units.filter(F.char_length("unit") > 3).groupBy("unit").agg(inside.alias("a"), (F.count(F.lit(1)) - inside).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (n - toxic + 1))
    found = (
        counted.filter(F.col("a") >= max(3, math.ceil(toxic / 100)))
        .withColumn("odds", odds)
        .filter(F.col("odds") > least)
        .withColumn("kind", F.substring("unit", 1, 1))
        .orderBy(F.desc(F.col("odds") * F.sqrt("a")), "unit")
        .limit(2 * size)
        .collect()
    )
    kept = {k: {r["unit"][1:]: r["odds"] for r in found if r["kind"] == k} for k in "wp"}
    return Lexicon(words=kept["w"], prefixes=kept["p"])


# ---- trees


@dataclass
class Tree:
    """A full binary tree by level: the feature and threshold of each inner node, the value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.leaf[at - (2**self.depth - 1)]


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """Boosting on the logistic loss by histograms of gradients, second order."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = math.log(share / (1 - share))
    margin = np.full(len(y), start)
    out: list[Tree] = []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(y), int)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            cut_at = np.full(nodes, -1)
            chosen = np.zeros(nodes, int)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = (at - first) * width + binned[:, j]
                gs = np.cumsum(np.bincount(cell, g, nodes * width).reshape(nodes, width), 1)
                hs = np.cumsum(np.bincount(cell, h, nodes * width).reshape(nodes, width), 1)
                score = lambda a, b: a * a / (b + ridge)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                gain[:, -1] = 0
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best
                best[better], cut_at[better], chosen[better] = gain[np.arange(nodes), top][better], top[better], j
            for k in np.flatnonzero(cut_at >= 0):
                feature[first + k], threshold[first + k] = chosen[k], cuts[chosen[k]][cut_at[k]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        cell = at - inner
        leaf = -rate * np.bincount(cell, g, 2**depth) / (np.bincount(cell, h, 2**depth) + ridge)
        out.append(Tree(feature, threshold, leaf, depth))
        margin += leaf[cell]
    return start, out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean margin and share of label 1 of each block, both rising. Equal margins are pooled first."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, y)
    blocks: list[list[float]] = []
    for m, w, s in zip(at, weight, total, strict=True):
        blocks.append([m * w, w, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    base: float
    trees: list[Tree] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    tokens: Tokens | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not self.trees:
            return np.full(len(texts), self.base)
        if self.tokens is None:
            self.tokens = Tokens(self.lexicon)
        m = self.margin(np.array([features(t or "", self.tokens) for t in texts], float).reshape(-1, FEATURES))
        # a hundredth of the uncalibrated score keeps the order inside a block of the calibration
        return 0.99 * np.interp(m, *self.steps) + 0.01 / (1 + np.exp(-m))


def train(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (5, 0), rows: int = SAMPLE_ROWS, label: str = "toxic") -> ToxicityModel:
    """Learns from at most ``rows`` labelled documents outside the held-out fold; only their features come to the driver.

    With no usable label every score is 0; with labels of one kind only, that label.
    """
    sample = labelled_sample(docs, labels, label, holdout, rows)
    lexicon = learn_lexicon(sample)

    @arrow_udf("array<double>")
    def dense(texts: pa.Array) -> pa.Array:
        tokens = Tokens(lexicon)
        return pa.array([features(t, tokens) for t in Texts(texts)], pa.list_(pa.float64()))

    table = sample.select("doc_id", "label", dense("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r"))
    got = table.select("doc_id", "r.label", "r.x").orderBy("doc_id").toPandas()
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, float(y[0]) if len(y) else 0.0)
    x = np.stack(got["x"].to_numpy()).astype(float)
    aside = (got["doc_id"].to_numpy() * 2654435761 % 2**32 % 5) == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 5 or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    base, trees = grow(x[~aside], y[~aside])
    model = ToxicityModel(lexicon, base, trees)
    model.steps = isotonic(model.margin(x[aside] if aside.any() else x), y[aside] if aside.any() else y)
    return model


def scorer(model):
    """A column function from text to score; the model has a few hundred words and a few thousand numbers."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(Texts(texts)), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (5, 0), rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Input: docs with doc_id and text, labels with doc_id and toxic; other columns are ignored. A document is held out when
    CRC32 of its doc_id as text leaves ``holdout[1]`` modulo ``holdout[0]``; a row without doc_id is not, and has no label. A null text is
    empty. Whole texts are read, in the rows' own tasks; nothing is shuffled to score. An empty table gives an empty result.
    """
    score = scorer(train(docs, labels, holdout, rows))
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), holdout[0]) == holdout[1]).alias("held_out"), score(text_of()).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, holdout: Sequence[int] = (5, 0), rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the model predicts clean, with all their columns."""
    name, = fresh(docs, "score")
    scored = docs.withColumn(name, scorer(train(docs, labels, holdout, rows))(text_of()))
    return scored.filter(F.col(name) < 0.5).drop(name)
