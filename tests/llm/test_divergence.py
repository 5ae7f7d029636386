import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from pressroom.llm import divergence, queries


def brute(rows, least=3, ranks=200):
    """The audit by plain loops over (lang, source, text)."""
    where, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = re.sub("[A-Z]", lambda m: m[0].lower(), term)
            where[lang, term].add(i)
            count[lang, source][term] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (name, t), docs in where.items() if name == lang and len(docs) >= least]
        sums = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        whole = {t: share(sum(count[lang, s][t] for s in sources), sum(sums.values())) for t in kept}
        p = {s: {t: share(count[lang, s][t], sums[s]) for t in kept} for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= ranks:
                        out.add((lang, s, part, item, value, rank))
    return out


def odd_rows():
    draw = random.Random(11)
    words = ["the", "The", "été", "naïve", "x", "Z", "\U0001f600", "ﬀ", "b9c"] + [chr(97 + i) * 3 for i in range(20)]
    rows = []
    for _ in range(400):
        source = draw.choice(["hot"] * 5 + ["a", "b", "Ab", "é", None])
        rows.append((draw.choice(["en", "fr", None]), source, " ".join(draw.choice(words) for _ in range(draw.randrange(30)))))
    rows += [("en", "wordless", "12 34 \n\t"), ("en", "null", None), ("en", "", ""), ("de", "alone", "ja ja ja"), ("it", "s1", "uno due"), ("it", "s2", "tre")]
    rows += [("en", "long", "Same\x00other-" * 60_000), ("en", "long", "w" * (divergence.SLICE + 5) + " tail"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("columns, held", [(divergence.BLOCK_COLUMNS, divergence.HELD_TERMS), (7, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, columns, held):
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, n long, level int, term string").repartition(5)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    expected = brute(rows)
    assert set(got) == expected and len(got) == len(expected)


def test_ranks_stop_and_ties_go_by_bytes(spark):
    rows = [("en", s, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)) if s == "a" else "other words") for s in "aaabbb"]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [tuple(r) for r in divergence.audit(df, term_ranks=50).filter("part = 'term' AND source = 'a'").orderBy("rank").collect()]
    assert got == sorted((r for r in brute(rows, ranks=50) if r[1:3] == ("a", "term")), key=lambda r: r[5]) and len(got) == 50


def test_nothing_and_no_kept_term(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    got = divergence.audit(spark.createDataFrame([("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)], schema)).collect()
    assert {r.value for r in got} == {0} and len(got) == 6


def test_product_of_panels():
    draw = np.random.default_rng(1)
    x = draw.random((50, 23)) < 0.2
    row, column = np.nonzero(x)
    want = x.astype(int).T @ x.astype(int)
    for panel in (4, 64):
        got = np.zeros((23, 23), int)
        for i, j, n in divergence.gram_cells(row, column, 50, panel):
            assert (i <= j).all()
            got[i, j] += n
        assert (got == np.triu(want)).all()


def test_joint_tables_count_terms(spark):
    rows = spark.createDataFrame(
        [("en", b"t1", 5, [("a", 2), ("b", 3)]), ("en", b"t2", 5, [("b", 3), ("a", 2)]), ("en", b"t3", 1, [("a", 1)]), ("fr", b"t1", 2, [("a", 2)])],
        "lang string, term binary, total long, cells array<struct<source: string, n: long>>",
    )
    got = {tuple(r) for r in divergence.joint_tables(rows.repartition(3)).collect()}
    assert got == {("en", "a", 2, "b", 3, 2), ("en", "a", 2, "a", 2, 2), ("en", "b", 3, "b", 3, 2), ("en", "a", 1, "a", 1, 1), ("fr", "a", 2, "a", 2, 1)}


def test_shares_are_exact_beyond_a_long(spark):
    n, v = 10**12, 77
    levels = spark.createDataFrame([(0,), (5 * 10**11,), (n,)], "level long")
    got = [r[0] for r in levels.select(divergence.share(F.col("level"), F.lit(n), F.lit(v))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c in (0, 5 * 10**11, n)]


def test_query_equals_its_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert compare(queries.QUERIES["op11_source_divergence"](spark, small), db, queries.SQL["op11_source_divergence"]) is None
