import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressroom.llm import chat, line_chunks

TURNS = "conv_id long, turn long, role string, text string, formatted string, nth int"
HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<s>", "[\\\\INST]", "\\", "<", "</s", "[/INST]</s>[INST]user[/INST]", "", None, "ü\n漢\U0001f600", "a" * 200_000]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_of_hard_turns(spark):
    rows = [(i, k, role, text, "clash", 7) for i, (role, text) in enumerate([("user", t) for t in HARD] + [(t, "x") for t in HARD]) for k in (0, 1)]
    rows += [(None, 1, "user", "no id", "", 0), (500, None, None, None, "", 0), (501, 1, "assistant", "tie", "", 0), (501, 1, "assistant", "tie", "", 0)]
    df = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    df = df.withColumn("loss", chat.loss_text(df.formatted, df.loss_spans)).withColumn("digest", chat.digest_of_turns(df.turns))
    source = {}
    for c, t, r, x, *_ in rows:
        source.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in df.collect()}
    assert got.keys() == source.keys()
    for c, turns in source.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        row = got[c]
        assert row.round_trip and row.n_turns == len(turns)
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.digest == digest(turns)
        assert row.loss == "".join(t for r, t in turns if r == "assistant")
        assert row.formatted.count("</s>") == len(turns)


def test_plain_turns_are_not_escaped(spark):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a \\ b < c", "", 0)], TURNS))
    assert df.first().formatted == "<s>[INST]user[/INST]a \\ b < c</s>" and df.first().escaped_turns == 0


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "/", "s", ">", "\\", "[", "INST", "]", "[/INST]", "</s>", "x"]), max_size=12).map("".join), min_size=1, max_size=8))
def test_any_text_comes_back(spark, texts):
    df = chat.format_conversations(spark.createDataFrame([(0, i, "assistant", t, "", 0) for i, t in enumerate(texts)], TURNS))
    row = df.withColumn("loss", chat.loss_text(df.formatted, df.loss_spans)).first()
    assert [t.text for t in row.turns] == texts and row.loss == "".join(texts)


# ---- line chunks


def brute_force(docs):
    """Chunks and removals by plain Python."""

    def chunks(text):
        out, held, before = [], [], 0
        for line in text.split("\n"):
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            held.append(line)
            if (h + 31 * before) % 3 == 0:
                out.append(held)
                held = []
            before = h
        return out + [held] * bool(held)

    places, cut = {}, []
    for doc_id, text in docs:
        text = text or ""
        key = (doc_id is not None, doc_id or 0, hashlib.md5(text.encode()).hexdigest())
        parts = chunks(text)
        cut.append((key, parts))
        for pos, part in enumerate(parts):
            if len(part) > 1:
                places.setdefault("\n".join(part), set()).add((*key, pos))
    out = []
    for (doc_id, _), (key, parts) in zip(docs, cut, strict=True):
        gone = [len(p) > 1 and min(places["\n".join(p)]) != (*key, i) for i, p in enumerate(parts)]
        out.append((doc_id, sum(map(len, parts)), sum(len(p) for p, g in zip(parts, gone, strict=True) if g), "\n".join("\n".join(p) for p, g in zip(parts, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_chunks_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    passages = [[f"line {p} {i}" for i in range(draw.randrange(4, 12))] for p in range(5)]
    docs = []
    for d in range(60):
        lines = [f"own {zlib.crc32(f'{d} {i}'.encode())}" for i in range(draw.randrange(0, 9))]
        for p in draw.sample(passages, draw.randrange(0, 3)):
            at = draw.randrange(len(lines) + 1)
            lines[at:at] = p
        docs.append((d, "\n".join(lines)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "\n\n\n"), (903, "x\n" * 20_000)]
    df = spark.createDataFrame([(d, t, 1, [2]) for d, t in docs], "doc_id long, text string, pos int, chunks array<int>")
    got = sorted((tuple(r) for r in line_chunks.drop_repeated_chunks(df).collect()), key=repr)
    assert got == brute_force(docs)
    assert any(r[2] for r in got)


def test_no_documents(spark):
    assert line_chunks.drop_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_passages(docs):
    """Removals of repeated runs by comparing every pair of neighbouring lines, in plain Python."""
    places, cut = {}, []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        key = (doc_id is not None, doc_id or 0, hashlib.md5((text or "").encode()).hexdigest())
        full = [i for i, line in enumerate(lines) if line.strip(" ")]
        windows = [(i, j, "\n".join(lines[i : j + 1])) for i, j in zip(full, full[1:])]
        cut.append((key, lines, windows))
        for i, _, w in windows:
            places.setdefault(w, set()).add((*key, i))
    out = []
    for (doc_id, _), (key, lines, windows) in zip(docs, cut, strict=True):
        gone = {n for i, j, w in windows if min(places[w]) != (*key, i) for n in range(i, j + 1)}
        out.append((doc_id, len(lines), len(gone), "\n".join(line for n, line in enumerate(lines) if n not in gone)))
    return sorted(out, key=repr)


def test_repeated_passages_go_whatever_surrounds_them(spark):
    draw = random.Random(5)
    passages = [[f"line {p} {i}" if i != 2 else " " for i in range(draw.randrange(2, 6))] for p in range(6)]
    docs = []
    for d in range(80):
        lines = [f"own {zlib.crc32(f'{d} {i}'.encode())}" for i in range(draw.randrange(1, 9))]
        for p in draw.sample(passages, draw.randrange(0, 3)):
            at = draw.randrange(len(lines) + 1)
            lines[at:at] = p
        docs.append((d, "\n".join(lines)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "\n\n\n"), (903, "x\n" * 2_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, pos int")
    got = sorted((tuple(r) for r in line_chunks.drop_repeated_passages(df).collect()), key=repr)
    assert got == plain_passages(docs)
    short = spark.createDataFrame([(d, f"before {d}\nshared a\nshared b\nafter {d}") for d in range(30)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_chunks.drop_repeated_passages(short).collect()}
    assert left == {d: f"before {d}\nafter {d}" if d else "before 0\nshared a\nshared b\nafter 0" for d in range(30)}
    assert line_chunks.drop_repeated_passages(df.limit(0)).count() == 0


def test_unlike_chunks_of_one_key_stay_apart(spark, monkeypatch):
    """With a key that all chunks share, only equal bytes are repeats."""
    found = line_chunks._occurrences
    monkeypatch.setattr(line_chunks, "_occurrences", lambda *a: found(*a).withColumn("chunk_key", F.lit("same")))
    docs = [(d, "\n".join(f"line {(d + i) % 4} {i}" for i in range(12))) for d in range(12)]
    got = sorted((tuple(r) for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_force(docs) and any(r[2] for r in got)


def test_bytes_of_chunks_are_sent_once(spark):
    docs = spark.createDataFrame([(d, "a\nb\nc\nd\ne\nf") for d in range(4)], "doc_id long, text string")
    plan = line_chunks.drop_repeated_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_key" in plan and not re.search(r"chunk#\d+ = chunk#\d+", plan)
