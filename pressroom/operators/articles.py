"""Page → article: element rows, time candidates and the assembly of all article fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ARTICLE_TIME_FIELDS, parse_article_time
from ..functions.html import attr, element_text, find_element, meta, page_outline
from ..functions.jsonld import jsonld_fields
from ..functions.text import (
    MIN_WORDS,
    article_gate,
    clean_text,
    col,
    content_hash,
    first_nonblank,
    let,
    optional,
    trim_space,
    word_count,
)
from ..functions.urls import resolve_url, url_parts
from ..schemas import ARTICLE_COLUMNS

# The page's own metadata names, in the order they are tried.
DATE_METAS = ("dcterms.created", "dcterms.issued", "dcterms.available")


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element in document order: key, ordinal, parent, depth, tag, attrs and ``lo``/``hi``.

    ``lo`` and ``hi`` are offsets into the page's text, which :func:`page_outline` returns next to the elements: the text
    of nested elements is not repeated for each of them.
    """
    outline = pages.select(key, page_outline(html, fields_only=False).alias("_outline"))
    return outline.select(key, F.inline("_outline.elements"))


def first_element(elements: DataFrame, key: str, tag: str = "", name: str = "", value: str = "") -> DataFrame:
    """First element per page with the tag and the exact attribute value, from element rows."""
    hit = F.lit(True) if not tag else F.col("tag") == tag
    if name:
        found = F.coalesce(trim_space(F.try_element_at("attrs", F.lit(name.lower()))), F.lit(""))
        hit = hit & (found == value)
    row = F.struct(*[c for c in elements.columns if c != key])
    return elements.filter(hit).groupBy(key).agg(F.min_by(row, "ordinal").alias("_first")).select(key, "_first.*")


def time_candidates(candidates: Sequence[tuple[Column, str]], last: tuple[Column, str] | None = None) -> Column:
    """ARRAY of STRUCT(raw, source, fallback) in order; ``last`` counts only when its date parses."""

    def entry(raw: Column, source: str, fallback: bool) -> Column:
        return F.struct(
            optional(first_nonblank(raw)).alias("raw"), F.lit(source).alias("source"), F.lit(fallback).alias("fallback")
        )

    rows = [entry(raw, source, False) for raw, source in candidates]
    return F.array(*rows, *([entry(*last, True)] if last is not None else []))


def pick_time(candidates: Column) -> Column:
    """The first candidate whose date parses, else the first that is not blank and no fallback, as an ArticleTime."""
    given = F.filter(candidates, lambda c: c["raw"].isNotNull())
    parsed = F.transform(
        given, lambda c: F.struct(parse_article_time(c["raw"], c["source"]).alias("time"), c["fallback"].alias("fallback"))
    )
    nothing = F.expr(f"from_json('{{\"precision\":\"unknown\"}}', '{ARTICLE_TIME_FIELDS}')")

    def choose(times: Column) -> Column:
        dated = F.filter(times, lambda t: t["time"]["date"].isNotNull())
        own = F.filter(times, lambda t: ~t["fallback"])
        return F.coalesce(F.get(dated, F.lit(0))["time"], F.get(own, F.lit(0))["time"], nothing)

    return let(parsed, choose)


def _article_candidates(outline: Column, data: Column, modified: bool) -> Column:
    field = "dateModified" if modified else "datePublished"
    prop = "article:modified_time" if modified else "article:published_time"
    elements = outline["elements"]
    item = find_element(elements, key="itemprop", value=field)
    stated = first_nonblank(attr(item, "content"), attr(item, "datetime"), element_text(outline["text"], item))
    candidates = [
        (data[field], f"json_ld.{field}"),
        (meta(elements, "property", prop), f"meta.{prop}"),
        (meta(elements, "name", prop), f"meta.{prop}"),
        (stated, f"itemprop.{field}"),
    ]
    if modified:
        return time_candidates(candidates)
    readable = first_nonblank(
        *[meta(elements, "name", name) for name in DATE_METAS], attr(find_element(elements, "time"), "datetime")
    )
    return time_candidates(candidates, (readable, "readability.date"))


def extract_articles(
    pages: DataFrame,
    html: str = "html",
    source_url: str = "url",
    final_url: str | None = None,
    robots_status: Column | None = None,
    fetched_at: Column | None = None,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Pages → all article fields plus ``reject_reason`` (NULL for an article that passes the quality gate).

    One Python pass outlines the page, the HTML is dropped right after it, and every field is resolved natively. The main
    text is our own block scoring (see :mod:`pressroom.functions.html`); when it is empty, JSON-LD's articleBody is taken.
    Other input columns are kept.
    """
    final_url = final_url or source_url
    kept = [c for c in pages.columns if c != html]
    df = pages.withColumn("_outline", page_outline(html)).drop(html)
    df = df.withColumn("_ld", jsonld_fields("_outline.article_json"))
    outline, ld = F.col("_outline"), F.col("_ld")
    elements, page_text = outline["elements"], outline["text"]

    def named(*names: tuple[str, str]) -> list[Column]:
        return [meta(elements, key, name) for key, name in names]

    document_title = element_text(page_text, find_element(elements, "title"))
    author_link = element_text(page_text, find_element(elements, key="rel", value="author"))
    canonical = first_nonblank(
        attr(find_element(elements, "link", "rel", "canonical"), "href"), ld["main_entity"], ld["url"], final_url
    )
    image = first_nonblank(ld["image"], *named(("property", "og:image"), ("name", "twitter:image")))
    df = df.withColumns(
        {
            "content": clean_text(first_nonblank(outline["main_text"], ld["articleBody"])),
            "title": first_nonblank(
                ld["headline"], *named(("property", "og:title"), ("name", "twitter:title")), document_title
            ),
            "_links": F.transform(F.array(canonical, image), lambda link: resolve_url(final_url, link)),
            "_has_image": image != "",
            "author": optional(first_nonblank(ld["author"], *named(("name", "author")), author_link)),
            "source": optional(first_nonblank(ld["publisher"], *named(("property", "og:site_name")))),
            "section": optional(ld["section"]),
            "description": optional(
                first_nonblank(ld["description"], *named(("name", "description"), ("property", "og:description")))
            ),
            # both times go through one copy of the parser
            "_times": F.transform(
                F.array(_article_candidates(outline, ld, False), _article_candidates(outline, ld, True)), pick_time
            ),
        }
    ).drop("_outline", "_ld")
    df = df.withColumns(
        {
            "word_count": word_count("content"),
            "canonical_url": F.col("_links")[0],
            "image_url": F.when(F.col("_has_image"), F.col("_links")[1]),
            "publication_time": F.col("_times")[0],
            "modification_time": F.col("_times")[1],
        }
    )
    unknown = F.lit("unknown") if robots_status is None else robots_status
    return df.select(
        *[c for c in kept if c not in ARTICLE_COLUMNS],
        F.lit("success").alias("status"),
        F.col(source_url).alias("source_url"),
        F.col(final_url).alias("final_url"),
        "canonical_url",
        F.coalesce(url_parts("canonical_url")["host"], F.lit("")).alias("domain"),
        "title",
        "author",
        F.col("publication_time.raw").alias("published_at"),
        F.col("modification_time.raw").alias("modified_at"),
        "publication_time",
        "modification_time",
        "source",
        "section",
        "description",
        "image_url",
        "content",
        "word_count",
        content_hash("content").alias("content_hash"),
        unknown.alias("robots_status"),
        (F.lit(None).cast("timestamp") if fetched_at is None else fetched_at).alias("fetched_at"),
        article_gate("word_count", "title", min_words).alias("reject_reason"),
    )


def item_outcome(reject_reason: Column | str) -> Column:
    """The gate's verdict as an attempt outcome: a rejected article is a permanent extraction failure."""
    reason = col(reject_reason)
    return F.struct(
        F.when(reason.isNotNull(), F.lit("extraction_failed")).alias("error_code"),
        reason.alias("error_detail"),
        F.when(reason.isNotNull(), F.lit(False)).alias("retryable"),
    )
