import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oracle import compare
from pressroom.llm import exact_dedup, queries, simhash
from pressroom.llm.exact_dedup import PatriciaTrie


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_trie_holds_what_was_put_in(keep):
    draw = random.Random(3)
    trie, expected, out = PatriciaTrie(keep), {}, {}
    for i in range(3000):
        key = bytes(draw.choice(b"ab") for _ in range(draw.randrange(9))) * draw.randrange(1, 3)
        trie.insert(key, i)
        expected.setdefault(key, []).append(i)
        if trie.size > 20_000 and trie.sizes:
            for k, owner, n in trie.spill():
                out.setdefault(k, []).append((owner, n))
    for k, owner, n in trie.terminals():
        out.setdefault(k, []).append((owner, n))
    best = max if keep == "max" else min
    assert {k: (best(o for o, _ in v), sum(n for _, n in v)) for k, v in out.items()} == {k: (best(v), len(v)) for k, v in expected.items()}


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 2000])
def test_exact_groups_equal_brute_force(spark, budget):
    draw = random.Random(4)
    texts = [None, "", "A b", "a B", "ä", "Ä", "x" * 300_000] + ["".join(draw.choice("abAB") for _ in range(draw.randrange(1, 7))) for _ in range(200)]
    rows = [(i, texts[i % len(texts)] if i % 3 else "the hot text") for i in range(700)]
    rows += [(None, "nobody's"), (None, "a b"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, 1, False, "z") for d, t in rows], "doc_id long, text string, keep_id int, kept boolean, sha string").repartition(7)
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    expected = set()
    for d, t in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        expected.add((d, keep, len(g), d == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(df, budget=budget).collect()]
    assert set(got) == expected and len(got) == len(expected)
    kept = exact_dedup.drop_exact_copies(df, budget=budget)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (e[0] for e in expected if e[3])))


def test_exact_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, threshold=3):
    """Smallest reachable place for each fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_groups_equal_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    long_one = " ".join(f"w{i}" for i in range(4000))
    docs += [(1000, None), (1001, " \t\n"), (1002, "One"), (1003, "one"), (1004, "one\x0btwo "), (1005, "ONE Two"), (1006, " x y\x00 z É"), (1007, long_one), (1008, long_one + " end")]
    docs += [(2, docs[2][1]), (None, "one"), (None, "only here and nowhere else")]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, print int, component_id string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(df).collect()}
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(prints)
    first = {}
    for (d, _), r in zip(docs, roots, strict=True):
        if d is not None:
            first[r] = min(first.get(r, d), d)
    assert got == {(d, f"{p:016x}", first.get(r)) for (d, _), p, r in zip(docs, prints, roots, strict=True)}
    kept = simhash.keep_first_of_groups(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(first.values())) and ids.count(None) == 1


@pytest.mark.parametrize("block", [simhash.BLOCK, 5])
def test_links_lose_no_pair_whatever_the_blocks(spark, block):
    draw = random.Random(6)
    prints = {draw.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(8):
            for k in range(draw.randrange(1, 4)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.near_links(df, block=block)).collect()}
    plain = plain_components(prints)
    groups, ours = {}, {}
    for p, r in zip(prints, plain, strict=True):
        groups.setdefault(r, set()).add(p)
        ours.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_home_of_a_near_half_is_visited():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2**63, 500, dtype=np.uint64)
    for bit in range(64):
        y = x ^ np.uint64(1 << bit) ^ np.uint64(1 << ((bit + 32) % 64))
        homes = [dict(zip(p.tolist(), a.tolist(), strict=True)) for a, p, h in simhash.anchors(x) if h]
        visits = {}
        for a, p, _ in simhash.anchors(y):
            for i, j in zip(a.tolist(), p.tolist(), strict=True):
                visits.setdefault(j, set()).add(i)
        assert all(any(h[a] in visits[b] for h in homes) for a, b in zip(x.tolist(), y.tolist(), strict=True))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(1000 + i, 100) for i in range(50)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {1000 + i: 100 for i in range(50)}


def test_one_row_of_each_group_stays_however_rows_repeat(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a, 1), (5, a, 1), (None, a, 2), (5, a.upper(), 3), (None, b, 4), (None, b, 4), (7, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumn("print", F.lit("p")).withColumn("place", F.lit(0))
    kept = simhash.keep_first_of_groups(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert got == [(0, b), (5, a), (7, "")]


def test_near_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_first_of_groups(empty).count() == 0
    assert simhash.near_groups(empty.select(F.col("text"), "doc_id")).columns == ["doc_id", "fingerprint", "component_id"]


def test_exact_dedup_query_returns_repeated_rows_each(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "A"), (2, "a"), (3, None), (3, ""), (4, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op5_exact_dedup(spark, str(tmp_path))
    assert df.count() == len(rows)
    assert compare(df, db, queries.SQL["op5_exact_dedup"]) is None


def test_long_white_space_takes_no_time(spark):
    texts = ["a" + " " * 300_000 + "b c", " \t" * 150_000, "\n" * 200_000 + "x y z w" + "\x0b\x0c" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    simhash.with_hashes(df.withColumn("text", F.lit("a b c")), "w", "h").collect()
    start = time.perf_counter()
    got = [r.w for r in simhash.with_hashes(df, "w", "h").select("w").collect()]
    assert sorted(got) == sorted([["a", "b", "c"], [""], ["x", "y", "z", "w"]])
    assert time.perf_counter() - start < 5
