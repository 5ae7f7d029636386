import corpus_pipeline
from pressroom.llm import exact_dedup, quality, simhash, toxicity
from pressroom.llm.queries import QUERIES, SQL

MIDDLE = "/root/testdata/sf0.01"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    again = docs.filter("doc_id < 40").withColumn("doc_id", docs["doc_id"] + 100_000)
    docs = docs.unionByName(again)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, MIDDLE)
    assert good.columns == docs.columns
    assert ids(good) == ids(quality.score_documents(docs, labels).filter("predicted = 1"))
    clean = stages["toxicity"](spark, docs, MIDDLE)
    assert ids(clean) == ids(toxicity.score_documents(docs, labels).filter("predicted = 0"))
    single = stages["exact_dedup"](spark, docs, MIDDLE)
    assert ids(single) == ids(exact_dedup.exact_groups(docs).filter("kept"))
    apart = stages["near_dedup"](spark, docs, MIDDLE)
    assert ids(apart) == ids(simhash.near_groups(docs).select("component_id").distinct().withColumnRenamed("component_id", "doc_id"))
    packed = stages["packing"](spark, docs.limit(50), MIDDLE)
    assert packed.select("doc_id").distinct().count() == 50


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and SQL.keys() <= QUERIES.keys()


def test_the_whole_pipeline_runs(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.length > 0 for r in rows)


def test_stages_take_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(90_001, None), (90_002, ""), (90_003, " \n" * 20_000), (90_004, "word " * 60_000), (None, "no id"), (90_005, "twice"), (90_005, "twice")]
    rows = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], docs.schema).unionByName(docs.limit(30))
    clashing = rows.selectExpr("*", "1.0D AS score", "'k' AS _key", "0 AS print")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, small)
        assert got.columns == clashing.columns, name
        kept = {r.doc_id for r in got.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in rows.select("doc_id").collect()}, name
        if name in ("exact_dedup", "near_dedup"):
            assert got.filter("doc_id = 90005").count() == 1, name
        assert stage(spark, clashing.limit(0), small).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing.limit(0), small).count() == 0
