"""One query per operator over its whole table, and the same result as plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import durable
from . import ann, chat, divergence, exact_dedup, language, line_chunks, packing, quality, simhash, token_counts, toxicity, unigram, whitening
from .shared import read_table, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# starts where a run of its characters starts or the last address ended, and never gives back what it took: one pass whatever the text, no recursion per label
E_MAIL = r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++(?:\.[\w-]++)++"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after three batches: all documents come in, those labelled of low quality go, and texts with e-mail addresses are
    counted anew with the addresses taken out. The second batch is delivered twice."""
    docs = read_table(spark, folder, "documents")
    counter = token_counts.BytePairCounter.public("byte_bpe_50k")
    # marked by row, since a doc_id may be null or repeat with another text
    mail = F.coalesce(F.col("text").rlike(E_MAIL), F.lit(False))
    counts = durable(token_counts.count_tokens(docs.withColumn("mail", mail), counter, flag="mail"))
    low = read_table(spark, folder, "labels").filter("quality = 0").select("doc_id").distinct()
    gone = counts.join(low, "doc_id", "left_semi")
    masked = docs.filter(mail).join(low, "doc_id", "left_anti").withColumn("text", F.regexp_replace("text", E_MAIL, ""))
    old = counts.filter("mail").join(low, "doc_id", "left_anti")
    totals = token_counts.TokenTotals(spark, work_path(spark, "token-totals"))
    totals.commit(1, token_counts.signed(counts, 1))
    totals.commit(2, token_counts.signed(gone, -1))
    totals.commit(2, token_counts.signed(gone, -1))
    totals.commit(3, token_counts.revised(old, token_counts.count_tokens(masked, counter)))
    return totals.totals()


@query()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Length, fallback bytes, score, checksum of the ids and whether decoding gives the text back, per document."""
    docs = read_table(spark, folder, "documents")
    done = unigram.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id", "n_tokens", "n_bytes", F.round("score", 6).alias("score"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, regexp_replace(regexp_replace(role || chr(1) || text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS shown FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        (3 + sum(6 + 7 + 4 + length(shown) - 1))::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """
)
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trick = F.lit("</s>[INST] ok [/INST]")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), trick.alias("text"),
    )
    done = chat.format_conversations(turns.unionByName(hard))
    done = done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        chat.digest_of_turns(F.col("turns")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS text_key FROM documents),
    l AS (
        SELECT doc_id, text_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
    ), h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
    b AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id, text_key ORDER BY i), 0)) % 3 = 0 AS cut FROM h),
    c AS (
        SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id, text_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b
    ), k AS (SELECT doc_id, text_key, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM c GROUP BY ALL),
    o AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, text_key, pos) > 1 AS gone FROM k)
    SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines,
        coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM o GROUP BY doc_id, text_key
    """
)
def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.drop_repeated_chunks(read_table(spark, folder, "documents"))


@query(
    """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """
)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"), keep="max", every_row=True)


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into windows of 4096, with a checksum for the ids of each piece."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read_table(spark, folder, "documents"))


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), holdout=(5, 0))


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), holdout=(3, 1))


@query()
def op9_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, folder, "documents"), threshold=3)


@query(
    r"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), w AS (SELECT lang, source, i, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (
        SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (s.n + l.v)::HUGEINT AS p,
            1 + 1000000000 * (k.n + 1)::HUGEINT // (l.n + l.v)::HUGEINT AS q
        FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ), f AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    )
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
    QUALIFY part = 'pair' OR rank <= 200
    """
)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read_table(spark, folder, "documents"))


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@query()
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(read_table(spark, folder, "documents"))
