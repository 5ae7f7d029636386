"""Page extraction queries over pages, and over article pages that Spark writes from documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import attr, element_text, find_element, meta, page_outline
from ..functions.jsonld import jsonld_article, jsonld_fields
from ..functions.register import register
from ..functions.text import article_gate, clean_text, content_hash, word_count
from ..functions.urls import LISTING_PREFIXES, is_listing
from ..operators.articles import extract_articles, first_element, html_elements, item_outcome
from ..operators.urls import dedupe_first, validate_urls
from ..sources.tables import articles_from_json, articles_to_json
from .catalog import case_of, query, table
from .flows import scrape_batches

# the page writer's text as SQL: tags stripped from an <article>, headings left out, one line per block
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "chr(160)"), ("&amp;", "&")]


def _decoded(text: str) -> str:
    for entity, plain in _ENTITIES:
        # HTML decodes these without their semicolon too, as a title that was cut short has them
        text = f"regexp_replace({text}, '{entity}?', {plain if plain.startswith('chr') else chr(39) + plain + chr(39)}, 'g')"
    return text


@query(
    f"""
    SELECT page_id, trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' \t\r\n' || chr(160)) AS title
    FROM pages"""
)
def page_titles(spark, folder):
    pages = table(spark, folder, "pages", spread=True).select("page_id", page_outline("html").alias("o"))
    title = element_text(F.col("o.text"), find_element(F.col("o.elements"), "title"))
    return pages.select("page_id", title.alias("title"))


@query(
    """
    WITH stripped AS (SELECT regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<(script|style)([^>]*)>.*?</(script|style)>', '<\\1\\2>', 'g') AS html FROM pages),
    tags AS (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^<>]*>', 1)) AS tag FROM stripped)
    SELECT lower(tag) AS tag, count(*) AS elements FROM tags GROUP BY 1"""
)
def element_counts(spark, folder):
    outlined = table(spark, folder, "pages", spread=True).select(page_outline("html", fields_only=False)["elements"]["tag"].alias("tags"))
    return outlined.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("elements"))


@query(
    """
    SELECT page_id, lower(regexp_extract(html, '(?i)<meta[^>]*charset="?([^">]*)', 1)) AS charset,
           regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link
    FROM pages"""
)
def first_elements(spark, folder):
    """First meta, first html and first link of a page, from element rows."""
    elements = html_elements(table(spark, folder, "pages"))

    def first(tag: str, key: str, name: str) -> DataFrame:
        found = first_element(elements, "page_id", tag)
        return found.select("page_id", F.element_at("attrs", key).alias(name))

    rows = table(spark, folder, "pages").select("page_id")
    for part in (first("meta", "charset", "charset"), first("html", "lang", "lang"), first("a", "href", "first_link")):
        rows = rows.join(part, "page_id", "left")
    return rows.fillna("", ["charset", "lang", "first_link"]).withColumn("charset", F.lower("charset"))


@query()
def element_tree(spark, folder):
    """Depth, width and text share of the element trees."""
    elements = html_elements(table(spark, folder, "pages"))
    return elements.groupBy("depth", "tag").agg(
        F.count("*").alias("elements"),
        F.countDistinct("page_id").alias("pages"),
        F.sum(F.col("hi") - F.col("lo")).alias("characters"),
    )


_ARTICLE_TEXT = f"""
    body AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
      '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|nav|aside|form|button|select|h1|template|svg)\\b.*?</(script|style|nav|aside|form|button|select|h1|template|svg)>', chr(10), 'g') AS html FROM pages),
    lines AS (SELECT page_id, {_decoded(
        "regexp_replace(regexp_replace(regexp_replace(html, '[\\s]+', ' ', 'g'), '(?i)</?(p|br|div|ul|ol|li|table|tr|td|th|tbody|thead|h2|h3|h4|section|blockquote|pre|figure|figcaption|hr|dl|dt|dd)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    )} AS text FROM body),
    cleaned AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(regexp_replace(x, '[\\s]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS content FROM lines)"""


@query(
    f"""
    WITH {_ARTICLE_TEXT}
    SELECT page_id, sha256(content) AS content_hash, len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+'))::INTEGER AS words
    FROM cleaned"""
)
def main_texts(spark, folder):
    """Readable text of every page: navigation, advertisements, scripts and footers left out."""
    pages = table(spark, folder, "pages", spread=True).select("page_id", clean_text(page_outline("html")["main_text"]).alias("content"))
    return pages.select("page_id", content_hash("content").alias("content_hash"), word_count("content").alias("words"))


_LISTING_PAGE = (
    "regexp_matches(lower(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)), '^/?$" + "".join(f"|^{re.escape(p)}" for p in LISTING_PREFIXES) + "')"
)


@query(
    f"""
    WITH {_ARTICLE_TEXT},
    counted AS (SELECT page_id, len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+')) AS words FROM cleaned),
    judged AS (SELECT *, url LIKE 'https:%' AND {_LISTING_PAGE} AS listing, url LIKE 'https:%' AND NOT {_LISTING_PAGE} AS article,
      trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), chr(9) || chr(10) || chr(13) || ' ') <> '' AS titled FROM pages)
    SELECT regexp_extract(url, '([^./]+\\.[^./]+)(/|$|\\?|#)', 1) AS domain, count(*) AS pages,
           count(*) FILTER (WHERE article AND words >= 80 AND titled) AS accepted,
           count(*) FILTER (WHERE article AND words < 80) AS too_short,
           count(*) FILTER (WHERE article AND words >= 80 AND NOT titled) AS no_title,
           count(*) FILTER (WHERE listing) AS listing,
           count(*) FILTER (WHERE url LIKE 'http:%') AS rejected_urls,
           coalesce(sum(words) FILTER (WHERE article AND words >= 80 AND titled), 0)::BIGINT AS words
    FROM judged JOIN counted USING (page_id) GROUP BY 1"""
)
def corpus_summary(spark, folder):
    """Flagship: pages → validated URLs → main text → quality gate → counts per domain.

    Only accepted URLs reach the HTML stage's filter; one shuffle, of partial counts.
    """
    pages = table(spark, folder, "pages", spread=True)
    checked = validate_urls(pages, allowed_domains=["example.com", "example.net", "example.org"], idna=False)
    listing = F.coalesce(is_listing("normalized_url"), F.lit(False))
    checked = checked.select(
        F.regexp_extract("url", r"://[^/?#]*?([^./]+\.[^./?#]+)(?:[/?#]|$)", 1).alias("domain"),
        F.col("reject_reason").isNotNull().alias("rejected"),
        listing.alias("listing"),
        F.when(F.col("reject_reason").isNull() & ~listing, F.col("html")).alias("html"),
    )
    outlined = checked.withColumn("_o", page_outline("html")).drop("html")
    outline = F.col("_o")
    read = outlined.select(
        "domain",
        "rejected",
        "listing",
        clean_text(outline["main_text"]).alias("content"),
        element_text(outline["text"], find_element(outline["elements"], "title")).alias("title"),
    ).withColumn("words", word_count("content"))
    verdict = article_gate("words", "title")
    article = ~F.col("rejected") & ~F.col("listing")
    good = article & verdict.isNull()
    return read.groupBy("domain").agg(
        F.count("*").alias("pages"),
        F.count_if(good).alias("accepted"),
        F.count_if(article & (verdict == "too_short")).alias("too_short"),
        F.count_if(article & (verdict == "no_title")).alias("no_title"),
        F.count_if("listing").alias("listing"),
        F.count_if("rejected").alias("rejected_urls"),
        F.coalesce(F.sum(F.when(good, F.col("words"))), F.lit(0)).cast("bigint").alias("words"),
    )


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def article_pages(documents: DataFrame) -> DataFrame:
    """An article page per document. Where its fields come from changes with the id: JSON-LD (plain, listed, nested in a
    graph), metas, an itemprop, or nowhere; every sixth page has broken JSON-LD before the good one."""
    key = F.col("doc_id")
    kind = F.pmod(key, F.lit(6))
    name = F.concat(F.lit("Reporter "), key)
    ld = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.when(kind == 1, F.array(F.lit("Thing"), F.lit("NewsArticle"))).otherwise(F.array(F.lit("Article"))).alias("@type"),
        F.concat(F.lit(" Headline "), key, F.lit(" ")).alias("headline"),
        F.array(F.struct(name.alias("name")), F.struct(F.lit("Desk").alias("name"))).alias("author"),
        F.struct(F.concat(F.lit("Media "), F.col("source")).alias("name")).alias("publisher"),
        F.struct(F.lit("/img/").alias("contentUrl")).alias("image"),
        F.array(F.col("lang"), F.lit("news")).alias("articleSection"),
        F.struct(F.concat(F.lit("/story/"), key).alias("@id")).alias("mainEntityOfPage"),
        F.concat(F.lit("2024-0"), key % 9 + 1, F.lit("-05T10:20:30+07:00")).alias("datePublished"),
    )
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebSite").alias("@type"), F.lit("x").alias("headline"))).alias("other"), ld.alias("main")))
    script = F.concat(F.lit('<script type="Application/LD+JSON">'), F.when(kind == 2, graph).otherwise(F.to_json(ld)), F.lit("</script>"))
    broken = F.lit('<script type="application/ld+json">{"@type":"Article",}</script>')
    head = (
        F.when(kind == 0, F.concat(broken, script))
        .when(kind < 3, script)
        .when(
            kind == 3,
            F.concat(
                F.lit('<meta property="og:title" content=" Og &amp; '), key,
                F.lit('"><META Name="author" content="Meta Author"><link rel="canonical" href="../canon?x=1"><meta property="og:image" '
                      'content="//cdn.example.com/i.png"><meta property="article:published_time" content="kemarin">'
                      '<meta name="article:published_time" content="5 Mei 2024 pukul 07.08 WITA"><meta property="og:site_name" content="Site">'),
            ),
        )
        .when(kind == 4, F.lit('<meta name="dcterms.created" content="2024-03-04T05:06:07Z">'))
        .otherwise(F.lit(""))
    )
    stamp = F.when(kind == 4, F.lit('<span itemprop="datePublished" datetime="31 Februari 2024">x</span>')).otherwise("")
    lines = F.regexp_replace(_escaped(F.col("text")), "\n", "</p><p>")
    title = F.when(kind == 5, F.lit("")).otherwise(F.concat(F.lit("Title &lt;"), key, F.lit("&gt;")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), title, F.lit("</title>"), head, F.lit("</head><body><nav><a href=/x>Menu</a></nav>"),
        stamp, F.lit("<div class='ad'>Buy now</div><article><h1>Heading</h1><p>"), lines, F.lit("</p></article><footer>Footer</footer></body></html>"),
    )
    url = F.concat(F.lit("https://news.example.com/a/b/"), key)
    return documents.select("doc_id", url.alias("url"), html.alias("html"))


_WORDS = "len(regexp_extract_all(content, '[\\p{L}\\p{Nd}_]+'))"
_DOC_CONTENT = """cleaned AS (SELECT doc_id, source, lang, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(regexp_replace(replace(x, chr(160), ' '), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS content
      FROM documents)"""


@query(
    f"""
    WITH {_DOC_CONTENT}
    SELECT doc_id,
      CASE WHEN k < 3 THEN 'Headline ' || doc_id WHEN k = 3 THEN 'Og & ' || doc_id WHEN k = 4 THEN 'Title <' || doc_id || '>' ELSE '' END AS title,
      CASE WHEN k < 3 THEN 'https://news.example.com/story/' || doc_id WHEN k = 3 THEN 'https://news.example.com/a/canon?x=1'
           ELSE 'https://news.example.com/a/b/' || doc_id END AS canonical_url,
      'news.example.com' AS domain,
      CASE WHEN k < 3 THEN 'Reporter ' || doc_id || ', Desk' WHEN k = 3 THEN 'Meta Author' END AS author,
      CASE WHEN k < 3 THEN 'Media ' || source WHEN k = 3 THEN 'Site' END AS source,
      CASE WHEN k < 3 THEN lang || ', news' END AS section,
      CASE WHEN k < 3 THEN 'https://news.example.com/img/' WHEN k = 3 THEN 'https://cdn.example.com/i.png' END AS image_url,
      CASE WHEN k < 3 THEN '2024-0' || (doc_id % 9 + 1) || '-05T10:20:30+07:00' WHEN k = 3 THEN '5 Mei 2024 pukul 07.08 WITA'
           WHEN k = 4 THEN '2024-03-04T05:06:07Z' END AS published_at,
      CASE WHEN k < 3 THEN 'json_ld.datePublished' WHEN k = 3 THEN 'meta.article:published_time' WHEN k = 4 THEN 'readability.date' END AS time_source,
      CASE WHEN k < 3 THEN epoch_us(make_timestamp(2024, (doc_id % 9 + 1)::INTEGER, 5, 3, 20, 30.0))
           WHEN k = 3 THEN epoch_us(TIMESTAMP '2024-05-04 23:08:00') WHEN k = 4 THEN epoch_us(TIMESTAMP '2024-03-04 05:06:07') END AS published_us,
      CASE WHEN k < 3 OR k = 4 THEN 'second' WHEN k = 3 THEN 'minute' ELSE 'unknown' END AS precision,
      {_WORDS}::INTEGER AS word_count, sha256(content) AS content_hash,
      CASE WHEN {_WORDS} < 80 THEN 'too_short' WHEN k = 5 THEN 'no_title' END AS reject_reason
    FROM (SELECT *, doc_id % 6 AS k FROM cleaned)"""
)
def extracted_articles(spark, folder):
    """All article fields of a page per document, whole texts, every field source in turn."""
    articles = extract_articles(article_pages(table(spark, folder, "documents", spread=True)))
    return articles.select(
        "doc_id", "title", "canonical_url", "domain", "author", "source", "section", "image_url", "published_at",
        F.col("publication_time.source").alias("time_source"),
        F.unix_micros("publication_time.utc").alias("published_us"),
        F.col("publication_time.precision").alias("precision"),
        "word_count", "content_hash", "reject_reason",
    )


@query()
def page_articles(spark, folder):
    """All article fields of the raw pages."""
    return extract_articles(table(spark, folder, "pages")).select(
        "page_id", "title", "canonical_url", "domain", "author", "published_at", "word_count", "content_hash", "reject_reason"
    )


@query(
    f"""
    WITH {_DOC_CONTENT}
    SELECT CASE WHEN {_WORDS} < 80 OR doc_id % 6 = 5 THEN 'extraction_failed' END AS error_code,
           CASE WHEN {_WORDS} < 80 THEN 'too_short' WHEN doc_id % 6 = 5 THEN 'no_title' END AS error_detail, count(*) AS articles
    FROM cleaned GROUP BY 1, 2"""
)
def extraction_outcomes(spark, folder):
    articles = extract_articles(article_pages(table(spark, folder, "documents", spread=True)))
    return articles.select(item_outcome("reject_reason").alias("o")).groupBy("o.error_code", "o.error_detail").agg(
        F.count("*").alias("articles")
    )


@query(
    f"""
    WITH {_DOC_CONTENT}
    SELECT doc_id, content_hash, word_count, nulls FROM (SELECT doc_id, sha256(content) AS content_hash, {_WORDS}::INTEGER AS word_count,
      (CASE WHEN doc_id % 6 IN (4, 5) THEN 4 WHEN doc_id % 6 = 3 THEN 2 ELSE 1 END)::INTEGER AS nulls FROM cleaned)"""
)
def article_json(spark, folder):
    """Articles written as JSON and read back; the JSON names its null fields."""
    articles = extract_articles(article_pages(table(spark, folder, "documents", spread=True))).drop("reject_reason")
    text = articles_to_json(articles.withColumn("fetched_at", F.timestamp_micros(F.lit(0))))
    back = articles_from_json(text.withColumn("nulls", _null_fields("article_json")))
    return back.select("doc_id", "content_hash", "word_count", "nulls")


def _null_fields(text: str) -> Column:
    names = ("author", "section", "description", "image_url")
    return sum(F.regexp_count(text, F.lit(f'"{name}":null')) for name in names)


@query(
    """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ann, Bob' WHEN 1 THEN 'Solo ' || doc_id WHEN 2 THEN 'Ann, Deep' ELSE '' END AS author,
      CASE doc_id % 4 WHEN 0 THEN 'P' ELSE '' END AS publisher,
      CASE doc_id % 4 WHEN 0 THEN '/1.png' WHEN 1 THEN '/2.png' WHEN 2 THEN '/3.png' ELSE '' END AS image,
      CASE doc_id % 4 WHEN 0 THEN 'a, b' WHEN 1 THEN 'solo' ELSE '' END AS section,
      CASE doc_id % 4 WHEN 0 THEN '/id' WHEN 1 THEN '/page' ELSE '' END AS main_entity,
      CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN '12.5' WHEN 2 THEN '1.234567e+06' ELSE '' END AS headline
    FROM documents"""
)
def jsonld_values(spark, folder):
    """Every shape a JSON-LD field may have."""
    key = F.col("doc_id")
    texts = [
        F.concat(
            F.lit('{"a":[1,{"@type":" Article ","headline":'), F.to_json(F.struct(F.col("lang").alias("x"))).substr(6, 100),
            F.lit(',"author":[{"name":"Ann"},"Bob",5.5e-400,{}],"publisher":{"name":"P"},"image":{"url":" ","contentUrl":"/1.png"},'
                  '"articleSection":["a","",{},"b"],"mainEntityOfPage":{"@id":"/id"}}]}'),
        ),
        F.concat(
            F.lit('{"@type":["X","NewsArticle"],"headline":12.50,"author":"Solo '), key,
            F.lit('","publisher":"none","image":["/2.png","/x.png"],"articleSection":" solo ","mainEntityOfPage":"/page"}'),
        ),
        F.lit('{"@type":"ReportageNewsArticle","headline":1234567,"author":[["Ann",[{"name":"Deep"}]],{"name":{}}],"image":[{"url":"/3.png"}],'
              '"articleSection":{"x":1},"mainEntityOfPage":{"url":"/no"}}'),
        F.lit('{"@type":"WebPage","headline":"not an article"}'),
    ]
    text = case_of(key, texts).alias("script")
    docs = table(spark, folder, "documents", spread=True).select("doc_id", text)
    docs = docs.withColumn("script", F.regexp_replace("script", r"5\.5e-400", "null")).withColumn(
        "script", F.when(key % 4 == 0, F.regexp_replace("script", r'("headline":"[^"]*")\}', "$1")).otherwise(F.col("script"))
    )
    ld = jsonld_fields(jsonld_article(F.array(F.lit("{broken"), F.col("script"))))
    return docs.withColumn("ld", ld).select(
        "doc_id", "ld.author", "ld.publisher", "ld.image", "ld.section", "ld.main_entity", "ld.headline"
    )


@query(
    """
    SELECT page_id, '' AS missing, lower(regexp_extract(html, '(?i)<meta[^>]*charset="?([^">]*)', 1)) AS charset FROM pages"""
)
def meta_lookup(spark, folder):
    pages = table(spark, folder, "pages", spread=True).select("page_id", page_outline("html")["elements"].alias("e"))
    first_meta = find_element(F.col("e"), "meta")
    return pages.select(
        "page_id",
        meta(F.col("e"), "property", "og:title").alias("missing"),
        F.lower(attr(first_meta, "CHARSET")).alias("charset"),
    )


@query(
    """
    WITH stripped AS (SELECT regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<(script|style)([^>]*)>.*?</(script|style)>', '<\\1\\2>', 'g') AS html FROM pages)
    SELECT 'h1' AS tag, sum(len(regexp_extract_all(html, '<h1[^>]*>')))::BIGINT AS elements FROM stripped"""
)
def sql_elements(spark, folder):
    """The table function in SQL, next to the page it reads."""
    register(spark)
    table(spark, folder, "pages", spread=True).createOrReplaceTempView("pressroom_pages")
    return spark.sql(
        "SELECT e.tag, count(*) AS elements FROM pressroom_pages, LATERAL html_elements(html) e WHERE e.tag = 'h1' GROUP BY e.tag"
    )


@query(
    f"""
    WITH {_ARTICLE_TEXT},
    n AS (SELECT page_id, url, min(page_id) OVER (PARTITION BY regexp_replace(split_part(url, '#', 1), '^(https?://[^/?]+)($|\\?)', '\\1/\\2')) AS body FROM pages),
    i AS (SELECT n.page_id // 50 AS job_id, url LIKE 'https:%' AS secure, body % 10 = 9 AS lost,
      len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+')) AS words FROM n JOIN cleaned ON cleaned.page_id = body)
    SELECT job_id, count(*) AS total, count(*) FILTER (WHERE secure AND NOT lost AND words >= 80) AS succeeded,
      count(*) FILTER (WHERE NOT secure) AS unsafe, count(*) FILTER (WHERE secure AND lost) AS queued,
      count(*) FILTER (WHERE secure AND NOT lost AND words < 80) AS too_short,
      coalesce(sum(words) FILTER (WHERE secure AND NOT lost AND words >= 80), 0)::BIGINT AS words
    FROM i GROUP BY 1"""
)
def scraped_batches(spark, folder):
    """Page URLs submitted in batches of fifty, run through the whole flow; every tenth page answers 503.

    Pages of the same address were fetched once: the log holds the first.
    """
    pages = table(spark, folder, "pages", spread=True)
    bare = F.regexp_replace("url", "#.*$", "")
    normal = F.regexp_replace(bare, "^(https?://[^/?]+)(?=[?]|$)", "$1/")
    batches = pages.groupBy(F.floor(F.col("page_id") / 50).alias("job_id")).agg(F.collect_list("url").alias("urls"))
    fetched = dedupe_first(pages.select("page_id", "html", normal.alias("url")), "url", ["page_id"])
    log = fetched.select(
        "url",
        F.when(F.col("page_id") % 10 == 9, 503).otherwise(200).alias("status"),
        F.lit(None).cast("string").alias("location"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.col("html").alias("body"),
    )
    hosts = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()
    robots = hosts.select("host", F.lit(404).alias("status"), F.lit("").alias("body"))
    jobs = batches.select("job_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("start_date", "date"), ("end_date", "date"), ("timezone", "string"))])
    now = F.timestamp_micros(F.lit(0))
    items, _ = scrape_batches(batches, log, robots, jobs, now, "newsbot", idna=False)
    failed = F.col("error_code")
    return items.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(failed == "unsafe_url").alias("unsafe"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("error_detail") == "too_short").alias("too_short"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("word_count"))), F.lit(0)).cast("bigint").alias("words"),
    )
