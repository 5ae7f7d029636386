"""Readers: captured network results enter as tables with a fixed schema, so that nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.skew import first_per_key
from ..schemas import ARTICLE, ARTICLE_COLUMNS, DNS, FETCH_LOG, RESULT_PAGES, ROBOTS


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row per fetched URL and hop."""
    return read_table(spark, path, FETCH_LOG, fmt)


def latest_captures(log: DataFrame, within: str = "second") -> DataFrame:
    """Of a fetch log one row per URL: its latest capture, and in it the last hop.

    The hops of one capture are fetched shortly after each other: ``fetched_at`` tells captures apart down to the unit ``within``. Spark keeps one
    row per URL and task before the shuffle.
    """
    order = [F.date_trunc(within, "fetched_at").desc_nulls_last(), F.col("hop").desc_nulls_last(), F.col("fetched_at").desc_nulls_last()]
    return first_per_key(log, ["url"], [*order, F.struct("status", "location", "content_type", "content_length", "body")])


def read_dns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Resolved addresses: one row per host and address."""
    return read_table(spark, path, DNS, fmt)


def read_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, ROBOTS, fmt)


def read_captured_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured search-provider responses, to be read by :func:`read_result_pages`."""
    return read_table(spark, path, RESULT_PAGES, fmt)


def articles_to_json(df: DataFrame, name: str = "article_json") -> DataFrame:
    """The article columns as one JSON text with its nulls kept; other columns stay."""
    text = F.to_json(F.struct(*ARTICLE_COLUMNS), {"ignoreNullFields": "false", "timestampFormat": _ISO})
    return df.select(*[c for c in df.columns if c not in ARTICLE_COLUMNS], text.alias(name))


def articles_from_json(df: DataFrame, name: str = "article_json") -> DataFrame:
    """The inverse of :func:`articles_to_json`."""
    return df.withColumn("_article", article_struct(name)).select(*[c for c in df.columns if c != name], "_article.*")


def article_struct(text: Column | str) -> Column:
    return F.from_json(col(text), ARTICLE, {"timestampFormat": _ISO})


_ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
