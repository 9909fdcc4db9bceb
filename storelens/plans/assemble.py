"""From pages and feeds to one insights row per site, plus the product catalog.

URLs decide which pages are needed at all (``needed_pages``). Their text is read once: ``page_digest`` takes everything
any rule needs in one scan stage and leaves short columns.  Only those are staged and shuffled, all by site.  The catalog stays a table
of its own (site, product), because a site's product list has no size bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import text, urls
from storelens.operators import brand, faqs, hero, links, policies, products, relations
from storelens.operators.ranking import first_per_key
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE
from storelens.session import stage
from storelens.sources import feeds as feed_source
from storelens.sources.pages import current_pages, needed_pages


@dataclass(frozen=True)
class Params:
    """Rule tables and switches of a build; every field can be replaced."""

    social_rules: tuple = rules.SOCIAL_RULES
    important_rules: tuple = rules.IMPORTANT_LINK_RULES
    policy_rules: tuple = rules.POLICY_LINK_RULES
    payment_rules: tuple = rules.PAYMENT_RULES
    hero_tags: tuple = rules.HERO_TAGS
    strict_social: bool = True
    hero_rank: str = "catalog"
    # Limits of the products that pages give a site without a feed; None keeps all.
    main_page_products: int | None = None
    product_pages: int | None = None
    products_per_page: int | None = None
    product_urls: int | None = None


def page_digest(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Everything the rules need of a page, without its HTML."""
    html = F.col("html")
    base = relations.with_site(pages)
    stamp = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    read = relations.with_dom(base, *PAGE, stamp.alias("fetched_at"), "html", text.markup(html).alias("body"))
    body = F.col("body")
    found = read.select(
        *PAGE, "fetched_at", "dom", "pieces",
        relations.platform_flag(html, F.col("url")).alias("on_platform"),
        relations.link_array(body, F.col("url")).alias("links"),
        F.regexp_extract_all(html, F.lit(relations.LD_PATTERN), F.lit(1)).alias("ld_blocks"),
        relations.title_text(html).alias("title"),
        relations.meta_content(html, "property", "og:site_name").alias("site_name"),
        relations.meta_content(html, "name", "description").alias("description"),
        relations.meta_content(html, "property", "og:description").alias("og_description"),
        brand.logo_alt().alias("logo_alt"),
        brand.logo().alias("logo_src"),
        F.concat(
            F.array_compact(F.array(relations.script_value(html, r"Shopify\.currency"))), brand.currency_codes()
        ).alias("codes"),
        brand.address().alias("address"),
        brand.has_contact_form(body).alias("has_form"),
        brand.payment_icons(body).alias("icons"),
        text.strip_tags(body).alias("shown"),
        relations.lead(body).alias("lead"),
    )
    named = brand.brand_description(brand.brand_name(found))
    return named.select(
        *PAGE, "fetched_at", "dom", "pieces", "links", "ld_blocks", "on_platform", "brand_name", "brand_description",
        urls.resolve_url(F.col("logo_src"), relations.base_url(F.col("url"))).alias("logo_url"),
        F.array_sort(F.array_distinct("codes")).alias("currencies"),
        brand.payment_names(F.lower("shown"), F.col("icons"), params.payment_rules).alias("payment_methods"),
        text.extract_emails(F.col("shown")).alias("emails"),
        text.extract_phones(F.col("shown")).alias("phones"),
        "address",
        F.when(F.col("has_form"), relations.base_url(F.col("url"))).alias("contact_form_url"),
        text.brand_category(F.col("lead")).alias("category"),
    )


def main_pages(digest: DataFrame) -> DataFrame:
    """The page that stands for a site: its home page, else its shallowest one."""
    # Of snapshots of one URL the newest; of equal times one by content, not by where its row lies.
    return first_per_key(digest, ["site"], ["page_rank", "url", F.col("fetched_at").desc_nulls_last(), F.xxhash64("brand_name", "links")])


def build_catalog(
    digest: DataFrame, main: DataFrame, feeds: DataFrame | None = None, sitemaps: DataFrame | None = None,
    params: Params = Params(),
) -> DataFrame:
    """Product catalog of every site: feed products, else products of its pages."""
    locs = feed_source.read_sitemap_urls(sitemaps) if sitemaps is not None else None
    from_pages = products.fallback_products(
        digest, main, locs, main_limit=params.main_page_products, page_limit=params.product_pages,
        per_page=params.products_per_page, url_limit=params.product_urls,
    )
    if feeds is None:
        return from_pages
    return products.catalog_with_fallback(
        products.products_from_feed(feed_source.read_product_feed(feeds)), from_pages
    )


@operator("assemble_insights")
def assemble_insights(parts: list[DataFrame]) -> DataFrame:
    """One row per site from parts that each have at most one row per site: one shuffle for all."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in union.columns if c != "site"]
    return union.groupBy("site").agg(*[F.any_value(F.col(c), F.lit(True)).alias(c) for c in names])


def _ordered(rows: DataFrame, order, fields, name: str) -> DataFrame:
    """Rows of a site as an ordered list; only for rows whose number per site has a fixed bound."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("record"))))
    return rows.groupBy("site").agg(F.transform(entries, lambda e: e["record"]).alias(name))


def insights_from_digest(
    digest: DataFrame,
    main: DataFrame,
    catalog: DataFrame,
    *,
    feeds: DataFrame | None = None,
    faq_feeds: DataFrame | None = None,
    params: Params = Params(),
) -> DataFrame:
    page_links = relations.links(main)
    facts = main.select(
        "site", F.col("url").alias("website_url"), "brand_name", "brand_description", "logo_url", "currencies",
        "payment_methods", "on_platform", "category",
        F.struct("emails", "phones", "address", "contact_form_url").alias("contact_details"),
        F.col("fetched_at").alias("scraped_at"),
    )
    social = links.social_links(page_links, params.social_rules, strict=params.strict_social)
    important = links.important_links(page_links, params.important_rules)
    linked = policies.policy_links(page_links, params.policy_rules).select(*policies.COLUMNS)
    embedded = policies.policy_embedded(main).select(*policies.COLUMNS)
    slots = policies.policy_slots(policies.dedup_policies(linked.unionByName(embedded)))
    slot_columns = [
        F.any_value(F.when(F.col("slot") == s, F.col("policy")), F.lit(True)).alias(s)
        for s, _ in rules.POLICY_SLOT_RULES
    ]
    feed_faqs = feed_source.read_faq_feed(faq_feeds) if faq_feeds is not None else None
    # All pages on a known path; repeated questions are dropped when the sources are joined.
    faq_pages = digest.filter(urls.path_of(F.col("url")).isin(*rules.FAQ_PATHS))
    questions = faqs.union_faqs(main, faq_pages, feed_faqs)
    if feeds is not None:
        listed = products.products_from_feed(feed_source.read_product_feed(feeds), style="hero")
        source = hero.hero_catalog_html(listed, main)
    else:
        source = hero.limit_per_site(products.union_products(main), rules.CATALOG_LIMIT)
    featured = hero.hero_products(source, main, hero_tags=params.hero_tags, rank=params.hero_rank)
    assembled = assemble_insights(
        [
            facts,
            _ordered(featured, ["hero_rank"], products.PRODUCT, "hero_products"),
            links.as_map(social, "social_handles"),
            links.as_map(important, "important_links"),
            slots.groupBy("site").agg(*slot_columns),
            _ordered(
                questions, ["source_rank", "page_rank", "url", "seq"], ["question", "answer", "category"], "faqs"
            ),
            products.total_products(catalog),
        ]
    )
    # A site that only has feeds has no main page and so no record; its products are in the catalog.
    return assembled.filter("website_url is not null").withColumn("total_products", F.coalesce("total_products", F.lit(0)))


def build_insights(
    pages: DataFrame,
    feeds: DataFrame | None = None,
    *,
    sitemaps: DataFrame | None = None,
    faq_feeds: DataFrame | None = None,
    params: Params = Params(),
    staged: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(insights: one row per site, catalog: one row per site and product).

    Only pages that a rule reads are parsed: main pages, known FAQ and collection paths, and product pages.
    ``staged`` writes the page digest once to the shared staging folder and lets every rule read
    its few columns from there; otherwise the rules' plan stays one lazy query.
    """
    keep = stage if staged else lambda df, name: df
    needed = needed_pages(pages, (*rules.FAQ_PATHS, *rules.COLLECTION_PATHS), ("/products/",))
    digest = keep(page_digest(current_pages(needed), params), "page_digest")
    main = keep(main_pages(digest), "main_pages")
    catalog = keep(build_catalog(digest, main, feeds, sitemaps, params), "catalog")
    insights = insights_from_digest(digest, main, catalog, feeds=feeds, faq_feeds=faq_feeds, params=params)
    return insights, catalog
