import math
import random

import numpy as np
import pytest

from pressroom.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(rows, components):
    x = [(v, [math.floor(64 * c) + 1_000_000 for c in e]) for v, e in rows]
    fit = sorted({tuple(e) for _, e in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(e, s, strict=True)] for e in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    away = [[n * a - b for a, b in zip(e, s, strict=True)] for _, e in x]
    white = (np.array(away, float) / n) @ axes / np.sqrt(values)
    return n, [sum(d * d for d in a) for a in away], white, values / np.trace(cov)


@pytest.mark.parametrize("block_rows, panel", [(whitening.BLOCK_ROWS, whitening.BLOCK_COLUMNS), (16, 5)])
def test_whitened_rows_equal_plain_algebra(spark, monkeypatch, block_rows, panel):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", panel)
    draw = random.Random(12)
    rows = [(i, [draw.gauss(0, 1 + k) for k in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1]), (5, rows[9][1])]  # a hot vector, no id, a repeated id
    bad = [(2000, None), (2001, [NAN] * 12), (2002, [INF] * 12), (2003, [None] * 12), (2004, [1.0] * 5), (2005, []), (2006, [1e300] * 12)]
    df = spark.createDataFrame([(v, e, "x", 1) for v, e in rows + bad], "vec_id long, embedding array<double>, x string, position int").repartition(6)
    got = whitening.whiten(df, components=7).toPandas()
    n, deviation, white, share = brute(rows, 7)
    assert len(got) == 7 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert sorted(got.deviation) == sorted(deviation * 7)
    by_id = got[got.vec_id == 42].sort_values("component")
    place = [v for v, _ in rows].index(42)
    sign = np.sign(by_id.whitened.to_numpy() * white[place])
    assert np.allclose(by_id.explained, share, rtol=1e-9)
    for i, (v, _) in enumerate(rows):
        if v not in (None, 5):
            one = got[got.vec_id == v].sort_values("component")
            assert np.allclose(one.whitened.to_numpy() * sign, white[i], atol=1e-8) and set(one.deviation) == {deviation[i]}


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0


def test_directions_without_variance_have_no_rows(spark):
    draw = random.Random(2)
    rows = [(i, [a := draw.gauss(0, 1), 2.0, draw.gauss(0, 1), a]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error[0] < 1e-9
    assert abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-9


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [(i % 2) * 2.0**39, float(i)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got.deviation.isna().all() and len(got) >= 50
