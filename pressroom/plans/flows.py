"""The two end-to-end flows, put together from the operators. Every step is lazy but for the redirect hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import includes_future
from ..operators.articles import extract_articles, item_outcome
from ..operators.fetch import classify_fetch, host_rules, resolve_redirects
from ..operators.jobs import classify_items, transition_items
from ..operators.search import advance, emitted_jobs, next_runs, usable_hits
from ..operators.skew import first_per_key
from ..sources.intake import explode_batches, read_result_pages


def scrape_batches(
    batches: DataFrame,
    fetch_log: DataFrame,
    robots: DataFrame,
    jobs: DataFrame,
    now,
    agent: str,
    min_words: int = 80,
    **policy,
) -> tuple[DataFrame, DataFrame]:
    """URL batches (job_id, urls) through the crawl log to job items → (items, rejected batches).

    ``jobs`` is (job_id, start_date, end_date, timezone). Bodies are read where the log has them and are never shuffled:
    responses that are no page are left out first, and only the articles' fields are joined to the chains.
    """
    submitted, rejects = explode_batches(batches, "job_id", "urls")
    chains = resolve_redirects(submitted, fetch_log, rules=host_rules(robots, agent), **policy)
    response = classify_fetch("status", "location", "content_type", "content_length", F.octet_length("body"))
    captured = F.col("fetched_at") if "fetched_at" in fetch_log.columns else F.lit(None).cast("timestamp")
    read = fetch_log.filter(response["outcome"] == "page").select(
        F.col("url").alias("final_url"), F.col("body").alias("html"), captured.alias("_captured")
    )
    articles = extract_articles(read, "html", "final_url", min_words=min_words).select(
        "final_url", "canonical_url", "domain", "title", "word_count", "content_hash", "publication_time",
        item_outcome("reject_reason").alias("_gate"), "_captured",
    )
    latest = [F.col("_captured").desc_nulls_last(), F.col("content_hash")]
    articles = first_per_key(articles, ["final_url"], latest).drop("_captured")
    ended = F.when(F.col("outcome") == "page", F.col("final_url"))
    joined = chains.withColumn("_page", ended).join(articles.withColumnRenamed("final_url", "_page"), "_page", "left")
    items = joined.withColumns(
        {
            "error_code": F.coalesce("error_code", "_gate.error_code"),
            "error_detail": F.coalesce("error_detail", "_gate.error_detail"),
            "attempts": F.lit(1),
            "status": F.lit("running"),
            "published_utc": F.col("publication_time.utc"),
            "published_date": F.col("publication_time.date"),
        }
    ).drop("_gate", "outcome", "_page")
    return classify_items(transition_items(items, now), jobs), rejects


def run_searches(
    runs: DataFrame, captured: DataFrame, seen: DataFrame, now, **policy
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One command of every dated search over captured provider pages → (jobs, items, next search runs).

    ``captured`` is (search_id, month, offset, status, body). Searches that reach into the future are left out.
    """
    pages = read_result_pages(captured)
    hits = usable_hits(pages, **policy).select("search_id", "month", "offset", "rank", "url")
    allowed = runs.filter(~includes_future("start_date", "end_date", "timezone", now))
    moved = advance(allowed, pages.drop("links", "error_detail"), hits, seen)
    jobs, items = emitted_jobs(moved)
    return jobs, items, next_runs(allowed, moved)

