"""Product feeds, page feeds, sitemaps and saved search-result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import text, urls
from storelens.operators import faqs, relations
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

FEED_SCHEMA = (
    "products array<struct<title:string,handle:string,body_html:string,images:array<struct<src:string>>,"
    "variants:array<struct<price:string,compare_at_price:string,available:boolean>>,tags:variant>>"
)


def _site_columns(df: DataFrame) -> DataFrame:
    return (
        df.filter(urls.valid_url(F.col("url")))
        .withColumn("site", urls.host_of(F.col("url")))
        .withColumn("page_rank", urls.page_rank(F.col("url")))
    )


def feed_base(url: Column) -> Column:
    return F.regexp_replace(url, r"/products\.json.*$", "")


@operator("read_product_feed")
def read_product_feed(feeds: DataFrame) -> DataFrame:
    """Feed pages ``(url, body)`` to one row per product, in page and position order.

    Feed pages are rows, so a catalog of any size is spread over the scan; bad JSON gives no rows.
    """
    page = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("bigint"), F.lit(1))
    parsed = _site_columns(feeds).select(
        *PAGE,
        feed_base(F.col("url")).alias("base_url"),
        page.alias("page"),
        F.from_json("body", FEED_SCHEMA).alias("doc"),
    )
    rows = parsed.select(*PAGE, "base_url", "page", F.posexplode("doc.products").alias("pos", "product"))
    # Page numbers come from URLs: one too large for an ordinal sorts last instead of ending the job.
    last = F.lit((1 << 63) - 1 - (1 << 31)) + F.col("pos")
    seq = F.coalesce(F.try_add(F.try_multiply(F.col("page"), F.lit(1_000_000)), F.col("pos")), last)
    return rows.withColumn("seq", seq).drop("page", "pos")


@operator("read_sitemap_urls")
def read_sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``<loc>`` values below ``<url>`` that are product pages, from ``(url, body)``."""
    entries = F.regexp_extract_all(
        "body", F.lit(r"(?is)<(?:[\w-]+:)?url(?:\s[^>]*)?>(.*?)</(?:[\w-]+:)?url\s*>"), F.lit(1)
    )
    rows = _site_columns(sitemaps).select("site", F.posexplode(entries).alias("seq", "entry"))
    loc = F.regexp_extract("entry", r"(?is)<(?:[\w-]+:)?loc\s*>\s*([^<]*?)\s*</", 1)
    return rows.select("site", "seq", text.unescape_html(loc).alias("loc")).filter(F.col("loc").contains("/products/"))


@operator("read_faq_feed")
def read_faq_feed(feeds: DataFrame) -> DataFrame:
    """Questions in the page bodies of page feeds ``(url, body)``; the URL loses its ``.json``."""
    body = text.unescape_html(F.get_json_object("body", "$.page.body_html"))
    pages = feeds.select(F.regexp_replace("url", r"\.json$", "").alias("url"), body.alias("html"))
    return faqs.faq_blocks(pages, whole_page=True)


@operator("read_search_links")
def read_search_links(pages: DataFrame, engines=rules.SEARCH_ENGINE_RULES) -> DataFrame:
    """Candidate URLs of saved result pages ``(site, strategy, query_rank, engine, url, html)``.

    The first n links of an engine's class are taken before the ``http`` and host filters. The cut is made in the row of
    a page, so each saved copy of a page has its own and only the links that stay are shuffled later.
    """
    keep, rank, limit, skipped = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0), F.lit(False)
    for i, (engine, cls, n, host) in enumerate(engines):
        here = F.col("engine") == engine
        keep = F.when(here, F.lit(cls or "")).otherwise(keep)
        rank = F.when(here, i).otherwise(rank)
        limit = F.when(here, n).otherwise(limit)
        if host:
            skipped = skipped | (here & F.col("url").contains(host))
    hrefs = relations.first_hrefs(F.col("html"), F.col("cls"), F.col("most"))
    known = pages.withColumns({"cls": keep, "most": limit}).filter("cls is not null")
    first = known.select(
        "site", "strategy", "query_rank", "engine", rank.alias("engine_rank"),
        F.posexplode(F.transform(hrefs, lambda h: F.trim(F.when(h.contains("&"), text.unescape_html(h)).otherwise(h)))).alias("place", "url"),
    )
    return first.filter(F.col("url").startswith("http") & ~skipped).select(
        "site", "strategy", "query_rank", "engine_rank", (F.col("place") + 1).alias("seq"), "url",
        F.concat(F.lit("search__search_"), F.col("engine")).alias("source"),
    )
