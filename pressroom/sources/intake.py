"""URL batch intake and captured search-provider pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

# Limits of one batch and of one provider response, and where the response holds its parts.
MAX_BATCH = 100
MAX_RESULT_BYTES = 2 * 1024 * 1024
RESULT_ROWS, RESULT_LINK, NEXT_PAGE, PROVIDER_ERROR = "$.organic_results", "$.link", "$.serpapi_pagination.next", "$.error"


def explode_batches(df: DataFrame, batch_id: str = "batch_id", urls: str = "urls") -> tuple[DataFrame, DataFrame]:
    """Batches of URLs → (items with a 0-based position, rejected batches with a reason).

    The size limit holds for the list as given; then values are trimmed and blanks dropped.
    """
    n = F.size(urls)
    kept = F.filter(F.transform(urls, trim_space), lambda u: u != "")
    checked = df.withColumns(
        {
            "_urls": kept,
            "reject_reason": F.when(F.col(urls).isNull() | (n < 1), "empty")
            .when(n > MAX_BATCH, "too_many")
            .when(F.size(kept) == 0, "all_blank"),
        }
    )
    items = checked.filter("reject_reason IS NULL").select(batch_id, F.posexplode("_urls").alias("position", "url"))
    rejects = checked.filter("reject_reason IS NOT NULL").select(batch_id, "reject_reason")
    return items, rejects


def read_result_pages(df: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """Captured provider responses → ``links`` (array in rank order, NULL where a row has no link), ``has_next``,
    ``error_code``, ``error_detail`` and ``retryable``; other columns are kept.

    A result list that is no array counts as empty. A NULL status is a failed connection.
    """
    doc = F.try_parse_json(F.when(F.octet_length(body) <= MAX_RESULT_BYTES, F.col(body)))
    df = df.withColumn("_doc", doc)
    doc = F.col("_doc")

    def part(path: str):
        return F.try_variant_get(doc, path, "variant")

    def present(value):
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))

    code = F.col(status)
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    broken = code.isNull() | (code.between(200, 299) & ~is_object)
    refused = ~code.between(200, 299)
    reported = present(part(PROVIDER_ERROR))
    failed = broken | refused | reported
    rows = F.coalesce(F.try_variant_get(doc, RESULT_ROWS, "array<variant>"), F.array().cast("array<variant>"))

    def link(row):
        value = F.try_variant_get(row, RESULT_LINK, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))

    has_next = (F.size(rows) > 0) & present(part(NEXT_PAGE))
    return df.select(
        *[c for c in df.columns if c not in (body, status, "_doc")],
        F.when(~failed, F.transform(rows, link)).alias("links"),
        F.when(~failed, has_next).alias("has_next"),
        F.when(failed, F.lit("fetch_failed")).alias("error_code"),
        F.when(broken, "provider cannot be reached or its response is invalid")
        .when(refused, "provider search failed; check account and quota")
        .when(reported, "provider returned an error; check account and quota")
        .alias("error_detail"),
        F.when(failed, broken | F.coalesce(code >= 500, F.lit(False))).alias("retryable"),
    )


def result_hits(pages: DataFrame) -> DataFrame:
    """Read result pages → one row per result: the page's columns, ``rank`` from 0 and ``link``."""
    keep = [c for c in pages.columns if c not in ("links", "has_next", "error_code", "error_detail", "retryable")]
    return pages.select(*keep, F.posexplode("links").alias("rank", "link"))
