import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from pressroom.llm import language


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def plain_bits(texts, data):
    """Code length of ``data`` after training on ``texts``, by the definition, one byte after the other."""
    seen = defaultdict(Counter)
    for text in texts:
        for i, c in enumerate(text):
            for order in range(min(language.ORDER, i) + 1):
                seen[text[i - order : i]][c] += 1
    kept = {c for c, n in seen.items() if not c or n.total() >= language.LEAST_SEEN}

    @cache
    def chance(context, c):
        if context not in kept:
            return 1 / 256 if context is None else chance(context[1:], c)
        n = seen[context]
        shorter = context[1:] if context else None
        room = sum(chance(shorter, b) for b in range(256) if b not in n)
        different = len(n) if room else 0
        if c in n:
            return n[c] / (n.total() + different)
        return different / (n.total() + different) * chance(shorter, c) / room

    return -sum(np.log2(chance(data[max(0, i - language.ORDER) : i], c)) for i, c in enumerate(data))


def test_code_lengths_by_the_definition(spark):
    draw = random.Random(13)
    texts = ["".join(draw.choice("aab \n") for _ in range(60)) for _ in range(6)]
    ids = [i for i in range(40) if fold(i) != 2][:6]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string")
    trees = language.train(docs)
    for data in (b"a", b"ab ba", b"zz\xff a\x00b", texts[0].encode()):
        assert trees.code_lengths(data)[0] == pytest.approx(plain_bits([t.encode() for t in texts], data), rel=1e-5)


def test_slices_do_not_change_a_code_length(spark, small, monkeypatch):
    trees = language.train(spark.read.parquet(f"{small}/documents.parquet"))
    chances = np.exp2(-trees.bits[1:].astype(float))
    many = np.ones(chances.shape[1])
    many[-1] = 256 - (chances.shape[1] - 1)
    assert np.allclose((chances * many[None, :, None]).sum(1), 1, atol=1e-5)
    data = ("Ein Satz mit Umlauten äöü. " * 40).encode()
    whole = trees.code_lengths(data)
    for size in (1, 3, 50):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.allclose(trees.code_lengths(data), whole, rtol=1e-6)


def test_held_out_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    odd = [(90001, None, "en"), (90002, "", "en"), (90003, "123 .,\n", None), (90004, "word " * 300_000, None), (None, "le chat", None), (90005, "漢字", "en"), (90005, "漢字", "en")]
    rows = docs.unionByName(spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in odd], docs.schema)).withColumnRenamed("n_chars", "digest")
    got = language.predict(rows).collect()
    assert len(got) == len(truth) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in got)
    held = [d for d in truth if fold(d) == 2]
    assert np.mean([by_id[d].lang_pred == truth[d] for d in held]) > 0.99
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (90001, 90002, 90003))
    assert by_id[90004].lang_pred == "en" and by_id[90005].lang_pred != "und"


def test_labels_of_the_held_out_fold_teach_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    swapped = [(r.doc_id, r.text, "zz" if fold(r.doc_id) == 2 else r.lang) for r in docs.collect()]
    got = language.predict(docs).orderBy("doc_id").collect()
    again = language.predict(spark.createDataFrame(swapped, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert got == again


def test_nothing_to_learn_from_and_a_small_model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    schema = "doc_id long, text string, lang string"
    assert language.predict(spark.createDataFrame([], schema)).count() == 0
    got = language.predict(spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], schema)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert len(language.train(docs, max_contexts=50).child) == 52
    assert language.train(docs, model_bytes=200_000).bits.nbytes <= 250_000
