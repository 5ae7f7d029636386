import random
import sys
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressroom.llm import ann, packing, quality, toxicity
from pressroom.llm.shared import labelled_sample, remainder

MIDDLE = "/root/testdata/sf0.1"
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "word " * 60_000), (9005, "\U0001f600漢"), (None, "no id"), (9002, ""), (9002, "")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    odd = spark.createDataFrame([(d, t, "en", "src", 0) for d, t in ODD], real.schema)
    return real.unionByName(odd).withColumns({"score": F.lit(0.5), "label": F.lit(1), "_score": F.lit("x")})


@pytest.fixture(scope="module")
def labels(spark):
    real = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 1), (9001, None, None), (3, 7, 7), (123_456_789, 1, 1)], real.schema)
    return real.unionByName(odd)


@pytest.mark.parametrize("module, label, holdout, keep", [(toxicity, "toxic", (5, 0), toxicity.drop_toxic), (quality, "quality", (3, 1), quality.keep_good)])
def test_held_out_rows_are_told_apart(spark, docs, labels, module, label, holdout, keep):
    got = {}
    scored = module.score_documents(docs, labels, holdout).collect()
    assert len(scored) == docs.count()
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % holdout[0] == holdout[1])
        got[r.doc_id] = r
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [(got[d].score, y) for d, y in truth.items() if d in got and got[d].held_out]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert area > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    kept = keep(docs, labels, holdout)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == (1 if label == "quality" else 0) for r in scored)


@pytest.mark.parametrize("module, default", [(toxicity, 0.0), (quality, 1.0)])
def test_no_labels_and_no_documents(spark, docs, labels, module, default):
    none = labels.limit(0)
    few = docs.limit(5)
    assert {r.score for r in module.score_documents(few, none).collect()} == {default}
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_scores_use_the_text_only(spark, docs, labels):
    model = quality.train(docs, labels)
    assert np.allclose(model.score(["some text here", None]), model.score(["some text here", ""]))
    a = model.indices(*quality.describe("some words to score"))
    every = [(i, j) for i in range(len(a[0])) for j in range(i)]
    slow = model.base + sum(model.w[i] * x for i, x in zip(*a, strict=True)) + sum(model.v[a[0][i]] @ model.v[a[0][j]] * a[1][i] * a[1][j] for i, j in every)
    assert abs(slow - model.margin(*a)) < 1e-9


def test_isotonic_is_the_nearest_rising_step():
    draw = random.Random(1)
    x = np.array([draw.randrange(20) for _ in range(300)], float)
    y = np.array([draw.random() < v / 20 for v in x], float)
    at, share = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()
    assert abs(share @ np.array([((x >= lo) & (x < hi)).sum() for lo, hi in zip([-1, *(at[:-1] + at[1:]) / 2], [*(at[:-1] + at[1:]) / 2, 99], strict=True)]) - y.sum()) < len(y)


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    base, trees = toxicity.grow(x, y)
    margin = base + sum(t(x) for t in trees)
    assert ((margin > 0) == y).mean() > 0.97


def test_hidden_words_count(spark):
    tokens = toxicity.Tokens(toxicity.Lexicon())
    plain, hidden, clean = (toxicity.features(t, tokens) for t in ("you idiot", "you 1d1ot id1ot", "you there"))
    assert plain[6] > 0 and hidden[14] > 0 and clean[6] == clean[14] == 0 and plain[8] > 0


# ---- memory of a Python worker


def two_models():
    size = quality.HASHED + quality.STATS * quality.BINS
    steps = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
    machine = quality.FactorMachine(0.0, [np.arange(11.0)] * quality.STATS, np.ones(size), np.ones((size, quality.RANK)), steps)
    tree = toxicity.Tree(np.zeros(7, int), np.ones(7), np.arange(8.0), 3)
    return machine, toxicity.ToxicityModel(toxicity.Lexicon(), 0.0, [tree], steps)


@pytest.mark.parametrize("model", two_models(), ids=["quality", "toxicity"])
def test_texts_of_a_batch_are_read_one_at_a_time(spark, model):
    texts = ["x" * 250_000] * 128 + [None, ""]
    batch = pa.array(texts)
    score = toxicity.scorer(model).func
    tracemalloc.start()
    got = score(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    assert list(got.to_pylist()) == model.score(texts).tolist()


def test_what_a_worker_remembers_is_bounded():
    encoder = packing.WordEncoder(packing.tokenizer_config(public_tokenizers.path("word_bpe_49k.json")))
    for remembered, use in ((h := quality.Hashes(), h.__getitem__), (t := toxicity.Tokens(toxicity.Lexicon()), t.__getitem__), (encoder.words, encoder.encode)):
        for i in range(250_000):
            use(f"w{i}")
        for i in range(60):
            use(f"{i}" + "x" * 20_000)
        assert len(remembered) <= 100_000
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in remembered.items()) < 20e6


# ---- nearest neighbours


def brute_force(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        scores = (x * x[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r.rank == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def test_recall_of_the_tree(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    truth = brute_force(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = by_query(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20))
    assert got.keys() == truth.keys() and all(len(v) == 20 for v in got.values())
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found[:3]:
            assert abs(s - float(np.dot(np.array(exact[q], float), np.array(exact[i], float)))) < 1e-12
    assert np.mean([len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) / 20 for q in truth]) >= 0.9


def test_odd_vectors_ties_and_a_hot_leaf(spark):
    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)]
    good = list(rows)
    bad = [(5000, None), (5020, []), (5040, [0.0] * 6), (5060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5080, [float("nan")] + [1.0] * 5), (5100, [float("inf")] + [1.0] * 5), (5120, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows + bad + rows[:4]], "vec_id long, embedding array<double>, leaf int, score double")
    got = by_query(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20, recall=1.0, sample_rows=500, block_rows=40, block_queries=3))
    truth = brute_force(good, [i for i, _ in good if i % 20 == 0], 20)
    assert got.keys() == truth.keys()
    hit = np.mean([len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) / 20 for q in truth])
    assert hit >= 0.95
    assert [i for i, _ in got[1000]] == [i for i, _ in truth[1000]]


def test_only_opened_leaves_are_compared():
    draw = np.random.default_rng(3)
    rows, ids, leaf = draw.normal(size=(400, 5)), draw.permutation(400), draw.integers(0, 9, 400)
    queries, query_ids = rows[:30], ids[:30]
    opened = [np.sort(draw.choice(12, draw.integers(0, 7), replace=False)) for _ in range(30)]
    a, b, score = ann.opened_only(query_ids, queries, np.concatenate(opened), np.array([len(o) for o in opened]), ids, rows, leaf, 7)
    for i in range(30):
        use = np.flatnonzero(np.isin(leaf, opened[i]) & (ids != query_ids[i]))
        exact = (rows[use] * queries[i]).sum(1)
        want = use[np.lexsort((ids[use], -exact))][:7]
        assert b[a == i].tolist() == want.tolist()


def test_recall_where_few_leaves_are_opened(spark, monkeypatch):
    """50,000 rows around 400 centres: recall holds while a query is compared with under a fifth of the rows."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(400, 16))
    x = (centres[np.arange(50_000) % 400] + 0.15 * draw.normal(size=(50_000, 16))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": list(x)}))
    visits = []
    monkeypatch.setattr(ann, "_calibrate", lambda *args, real=ann._calibrate: visits.append((args[1].leaves, real(*args))) or visits[-1][1])
    got = by_query(ann.nearest_neighbours(df, F.col("vec_id") % 500 == 0, k=20))
    leaves, opened = visits[0]
    assert opened < leaves / 5
    truth = brute_force(list(enumerate(x)), got, 20)
    assert len(got) == 100
    assert np.mean([len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) / 20 for q in truth]) >= 0.9


def test_fewer_candidates_than_asked_for(spark):
    schema = "vec_id long, embedding array<float>"
    got = by_query(ann.nearest_neighbours(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0])], schema), F.col("vec_id") % 20 == 0))
    assert got == {0: [(2, 3.0), (1, 1.0)]}
    assert ann.nearest_neighbours(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_small_leaves_are_not_the_end(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    monkeypatch.setattr(ann, "fit_tree", lambda x, fit=ann.fit_tree: fit(x, leaf_rows=10))
    monkeypatch.setattr(ann, "_calibrate", lambda *_: 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20, block_rows=10))
    assert len(got) == 20 and all(len(v) == 20 for v in got.values())
    few = by_query(ann.nearest_neighbours(df.filter("vec_id < 15"), F.col("vec_id") % 20 == 0, k=20, block_rows=10))
    assert {q: len(v) for q, v in few.items()} == {0: 14}


def test_the_sample_is_full_where_labels_cover_other_rows(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = spark.range(0, 5000, 25).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    sample = labelled_sample(docs, labels, "toxic", (5, 0), 100)
    assert sample.select("doc_id").distinct().count() == 100
    assert labelled_sample(docs, labels, "toxic", (5, 0), 10_000).count() == docs.filter(remainder(F.col("doc_id"), 5) != 0).count()
