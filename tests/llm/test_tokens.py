import random
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tokenizers import Tokenizer

from pressroom.llm import packing, queries, token_counts, unigram
from pressroom.llm.shared import work_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "a", "A.b,,c  \n", "it's we'll .' <|endoftext|> x", "é ß ǅ İ Σ漢字\U0001f600", "\x0b\x1c x­z ", "x" * 30_000, "1² ½ ª_", "▁marked▁"]


def mixed(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice("aB .,'\n_-é漢ß1²<|>x&$") for _ in range(draw.randrange(60))) for _ in range(n)]


# ---- packing


def test_words_encode_as_the_library_does():
    encoder, library = packing.WordEncoder(packing.tokenizer_config(WORDS)), Tokenizer.from_file(WORDS)
    for t in HARD + mixed(1, 1500):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_texts_that_are_encoded_together_give_the_ids_of_the_library():
    draw = random.Random(4)
    signs = ["".join(draw.choice("'''srtvelmd5.é SLEV\t\r\nÞµªº½²×") for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts = ["it's", "'s", "'re", "'l", "'", "''s", "x'", "'sam", "5's't", ".'ve", *HARD, *mixed(6, 1000), *signs]
    draw.shuffle(texts)
    encoder, library = packing.WordEncoder(packing.tokenizer_config(WORDS)), Tokenizer.from_file(WORDS)
    for _ in range(2):  # the second time with words remembered
        for t, ids in zip(texts, encoder.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert encoder.words and encoder.encode_all([]) == []


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


@pytest.fixture
def one_task(monkeypatch):
    """Runs the packer on rows in this process, with an encoder of its own."""
    config = packing.tokenizer_config(WORDS)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing.WordEncoder, "loaded", {})

    def run(texts, block_tokens=packing.BLOCK_TOKENS):
        encoder = packing.WordEncoder.of(config)
        encoder.model = counted = Counted(encoder.tokenizer.model)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        batches = [batch.slice(i, 7) for i in range(0, len(texts), 7)]
        return [r for b in packing._packer(config, 2, 4096, block_tokens)(iter(batches)) for r in b.to_pylist()], counted.calls

    return run


def test_words_of_texts_that_are_encoded_together_are_worked_out_once(one_task):
    draw = random.Random(7)
    words = list({"".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(120_000)})
    lines = [" ".join(w + draw.choice(["", ",", ".", ");"]) for w in words[i : i + 1000]) for i in range(0, len(words), 1000)]
    rows, calls = one_task(lines + lines)
    assert calls <= len(words) + 3
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_texts_are_packed_alike_however_many_are_encoded_together(one_task, monkeypatch):
    texts = HARD + mixed(8, 400) + ["many words " * 3000, ""]
    whole, _ = one_task(texts, 1500)
    for size in (1, 500):
        monkeypatch.setattr(packing, "TOGETHER", size)
        assert one_task(texts, 1500)[0] == whole


@pytest.mark.parametrize("lengths", [[], [5], [4096] * 3, [3000] * 400, [1] * 5000, [random.Random(2).randrange(1, 9000) for _ in range(900)]])
def test_packing_is_whole_and_full(lengths):
    sequences = packing.pack(lengths)
    pieces = sorted(p for s in sequences for p in s)
    at = {}
    for d, start, n in pieces:
        assert start == at.get(d, 0) and n > 0
        at[d] = start + n
    assert at == dict(enumerate(lengths))
    fills = [sum(p[2] for p in s) for s in sequences]
    assert all(f & (f - 1) == 0 and f <= 4096 for f in fills)
    assert sum(f < 4096 for f in fills) <= 12


def test_least_squares_finds_a_solution_that_exists():
    ways = packing.combinations(8, 3)
    x = np.arange(ways.shape[1], dtype=float)
    h = ways @ x
    found = packing.nonnegative_least_squares(ways, h, 3000)
    assert (found >= 0).all() and np.abs(ways @ found - h).max() < 0.05


def test_packed_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate([None, *HARD])] + [(None, "no id")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, offset int, ids string").repartition(3)
    rows = packing.pack_documents(df, WORDS, end_id=2, block_tokens=20_000).collect()
    library = Tokenizer.from_file(WORDS)
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.start)):
        got = whole.setdefault(r.doc_id, [])
        assert r.start == len(got)
        got += np.frombuffer(r.ids, "<u4").tolist()
    assert whole == {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs}
    assert all(r.length == len(r.ids) // 4 and r.doc_tokens == len(whole[r.doc_id]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS, 2).count() == 0


# ---- unigram


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores as a unigram model of the library."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    for a, b in zip(model.pieces, unigram.zipf_scores([(p.piece, p.score, p.type) for p in model.pieces]), strict=True):
        a.score = b[1]
    model.trainer_spec.model_type = 1
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def test_unigram_equals_the_library_but_for_ties(spark, small, library):
    u = unigram.Unigram.from_file(PIECES)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + HARD + mixed(3, 300)
    same = 0
    for t, (ids, score) in zip(texts, u.encode(texts), strict=True):
        ours, theirs = np.frombuffer(ids, "<u4").tolist(), library.encode(t)
        same += ours == theirs
        total = lambda x: sum(u.score[i] if not u.is_byte[i] else 0 for i in x)
        assert abs(total(ours) - total(theirs)) < 1e-3 * max(1, len(ours))
        assert u.decode(ids) == t.replace("▁", " ")
        assert library.decode(ours) == t.replace("▁", " ")
    assert same > 0.95 * len(texts)


def test_viterbi_equals_all_segmentations():
    pieces = [("<unk>", 0.0, 2)] + [(p, -s, 1) for p, s in {"a": 2.0, "b": 2.5, "ab": 3.0, "ba": 4.5, "aab": 4.0, "▁": 1.0, "▁a": 2.5}.items()]
    u = unigram.Unigram(pieces)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(w):
        if not w:
            return 0.0
        return max([score[w[:n]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in score], default=u.unknown_score + best(w[1:]) if w[0] not in score else -1e9)

    draw = random.Random(5)
    for _ in range(200):
        w = "".join(draw.choice("ab▁c") for _ in range(draw.randrange(1, 9)))
        assert abs(u.viterbi([w])[0][1] - best(w)) < 1e-9, w


def test_encoded_documents(spark):
    rows = [(i, t, 1.0) for i, t in enumerate([None, *HARD])] + [(3, HARD[2], 1.0), (None, "x y", None)]
    got = unigram.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, score double"), PIECES).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in got) == sorted((repr(d), (t or "").replace("▁", " ")) for d, t, _ in rows)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert unigram.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


# ---- token totals


def test_totals_follow_inserts_deletes_and_revisions(spark):
    counter = token_counts.BytePairCounter.public("byte_bpe_50k")
    schema = "doc_id long, source string, lang string, text string, tokens int"
    first = [(i, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None, ["", None, "some words here", "x" * 5000][i % 4], 1) for i in range(60)]
    first += [first[5], (None, "s1", "en", "no id", 1)]
    counts = token_counts.count_tokens(spark.createDataFrame(first, schema), counter)
    totals = token_counts.TokenTotals(spark, work_path(spark, "totals-test"))
    assert totals.totals().count() == 0
    assert totals.commit(1, token_counts.signed(counts, 1))
    gone, changed = counts.filter("doc_id % 5 = 0"), spark.createDataFrame([(1, "moved", "de", "now longer than before", 1)], schema)
    for _ in range(2):
        done = totals.commit(2, token_counts.signed(gone, -1).unionByName(token_counts.revised(counts.filter("doc_id = 1"), token_counts.count_tokens(changed, counter))))
    assert not done
    encoding = counter.encoding()
    expected = {}
    for d, s, la, t, _ in [r for r in first if r[0] is None or (r[0] % 5 and r[0] != 1)] + [(1, "moved", "de", "now longer than before", 1)]:
        n = expected.setdefault((s, la), [0, 0])
        n[0] += 1
        n[1] += len(encoding.encode_ordinary(t or ""))
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in totals.totals().collect()} == expected


def test_a_batch_without_commit_is_written_again(spark):
    totals = token_counts.TokenTotals(spark, work_path(spark, "totals-test"))
    deltas = spark.createDataFrame([("a", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs long, tokens long")
    deltas.write.parquet(f"{totals.folder}/deltas/batch=4")
    assert totals.totals().count() == 0
    assert totals.commit(4, deltas) and not totals.commit(4, deltas)
    assert totals.totals().collect()[0].tokens == 5


def test_checksum_of_ids(spark):
    from pressroom.llm.queries import packed

    row = packed(spark.createDataFrame([(1, "a")], "doc_id long, text string")).orderBy("start").first()
    ids = Tokenizer.from_file(WORDS).encode("a", add_special_tokens=False).ids + [2]
    assert row.ids_crc32 == zlib.crc32(np.array(ids[: row.length], "<u4").tobytes())


def test_addresses_are_counted_anew_by_row(spark, tmp_path):
    rows = [(1, "write to a@b.co please"), (1, "another text of the same id"), (None, "c@d.co is nobody's"), (None, "plain"), (2, "low e@f.co"), (2, "low"), (3, None)]
    spark.createDataFrame([(d, t, "s", "en") for d, t in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counter = token_counts.BytePairCounter.public("byte_bpe_50k")
    left = ["write to  please", rows[1][1], " is nobody's", "plain", ""]
    got = [tuple(r) for r in queries.op1_token_counts(spark, str(tmp_path)).select("docs", "tokens").collect()]
    assert got == [(5, sum(counter.count(t) for t in left))]


def test_addresses_in_hostile_texts_are_found_in_one_pass(spark):
    texts = ["a@b" + ".c" * 20_000, "w" * 400_000, "a." * 200_000, ("x@" * 100_000), "mail a@b.c+d@e.f, z@y", "@a.b q.r+s@t-u.v.", "x" * 80 + "@h.io"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df.select(F.regexp_replace(F.lit("a@b.c"), queries.E_MAIL, "")).collect()
    start = time.perf_counter()
    got = [r.t for r in df.orderBy("i").select(F.regexp_replace("text", queries.E_MAIL, "").alias("t")).collect()]
    assert time.perf_counter() - start < 5
    plain = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.ASCII)
    assert got[0] == "" and got[1:4] == texts[1:4] and got[4:] == [plain.sub("", t) for t in texts[4:]]


def test_addresses_as_the_plain_pattern_finds_them(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab.+-@@ ,") for _ in range(draw.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    plain = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
    new, old = F.regexp_replace("text", queries.E_MAIL, "~"), F.regexp_replace("text", plain, "~")
    assert df.filter(new != old).collect() == []


def test_what_is_remembered_is_bounded_by_bytes(monkeypatch):
    model = unigram.Unigram.from_file(PIECES)
    long = "漢字" * 20_000
    first = model.encode([long, "some words here", long + "x"])
    assert all(len(w) <= model.KEPT_LENGTH for w in model.ids_of) and model.ids_of.keys() == model.score_of.keys()
    monkeypatch.setattr(unigram.Unigram, "KEPT_BYTES", 2000)
    draw = random.Random(6)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    whole = [unigram.Unigram.from_file(PIECES).encode([t])[0] for t in texts[:5]]
    small = [model.encode([t])[0] for t in texts]
    assert small[:5] == whole and len(model.ids_of) < 200 and model.held < 60_000
    assert model.encode([long, "some words here", long + "x"]) == first


def test_models_of_many_characters():
    pieces = [("<unk>", 0.0, unigram.UNKNOWN)] + [(chr(0x4E00 + i), -float(i % 90) - 1, unigram.NORMAL) for i in range(20_000)] + [(chr(0x20000 + i), -5.0, unigram.NORMAL) for i in range(20_000)] + [("▁", -1.0, unigram.NORMAL)]
    model = unigram.Unigram(pieces)
    ids = np.frombuffer(model.encode([chr(0x4E00 + 19_999) + chr(0x20000 + 19_999)])[0][0], "<u4").tolist()
    assert ids == [40_001, 20_000, 40_000]
