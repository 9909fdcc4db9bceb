"""Featured products: by tag, by page position, and how they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom
from storelens.operators import products, relations
from storelens.operators.ranking import dedup_products, limit_per_key, limit_per_site
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

ORDER = products.ORDER


def _tags() -> Column:
    return F.coalesce("tags", F.array().cast("array<string>"))


def _is_homepage() -> Column:
    return F.array_contains(_tags(), rules.HOMEPAGE_TAG)


@operator("hero_by_tag")
def hero_by_tag(catalog: DataFrame, hero_tags=rules.HERO_TAGS) -> DataFrame:
    """Products with a featured tag; ``tag_rank`` puts homepage-tagged ones first."""
    tagged = catalog.filter(F.arrays_overlap(_tags(), F.array(*map(F.lit, hero_tags))))
    return tagged.withColumn("tag_rank", F.when(_is_homepage(), 0).otherwise(1))


def relevance_score(hero_tags=rules.HERO_TAGS) -> Column:
    """10 per featured tag, one boost for the best tag, and points for image, price and description."""
    matching = F.size(F.array_intersect(_tags(), F.array(*map(F.lit, hero_tags)))) * 10
    boost = F.when(F.lit(False), 0)
    for tags, points in rules.HERO_BOOSTS:
        boost = boost.when(F.arrays_overlap(_tags(), F.array(*map(F.lit, tags))), points)
    return matching + boost.otherwise(0) + _completeness(image=10, price=5, description=5)


def _completeness(**points) -> Column:
    present = {"image": "image_url", "price": "price_text", "description": "description"}
    total = F.lit(0)
    for name, score in points.items():
        total = total + F.when(F.coalesce(F.col(present[name]), F.lit("")) != "", score).otherwise(0)
    return total


@operator("hero_relevance")
def hero_relevance(catalog: DataFrame, hero_tags=rules.HERO_TAGS) -> DataFrame:
    """Featured products with a relevance score; rank by score, then catalog order."""
    return hero_by_tag(catalog, hero_tags).withColumn("score", relevance_score(hero_tags))


def _links_in(blocks: DataFrame) -> DataFrame:
    """Product links of the outline with what is inside and around them."""
    page = F.col("dom")
    anchors = F.filter(page, lambda e: (e["tag"] == "a") & F.coalesce(
        dom.raw_attr(e["opener"], "href").contains("/products/"), F.lit(False)))
    rows = F.transform(
        anchors,
        lambda e: F.struct(e.alias("card"), dom.inside(page, e).alias("parts"), dom.owners(page, e).alias("owners")),
    )
    return blocks.select(*PAGE, "pieces", F.inline(rows)).withColumn("seq", F.col("card.seq"))


def _placed(rows: DataFrame, kinds, item: Column) -> DataFrame:
    """One row per (block, page section it stands in), ordered as the sections are walked."""
    cases = ", ".join(
        f"if({dom.path_test(selector, 'owner', 'owners')}, named_struct('kind', {kind}, 'place', {place}), null)"
        for kind, (name, selectors) in enumerate(rules.HERO_SECTION_RULES)
        if name in kinds
        for place, selector in enumerate(selectors)
    )
    placed = (
        rows.withColumn("owner", F.explode("owners"))
        .withColumn("spot", F.explode(F.expr(f"array_compact(array({cases}))")))
        .withColumn("item", item)
        .filter(F.col("item").isNotNull())
    )
    # kind, selector and section first; then the item selector and the position on the page.
    return placed.withColumn("branch", F.col("spot.kind") * 100 + F.col("spot.place")).withColumn(
        "seq",
        (F.col("owner.seq") * 100 + F.col("item")).cast("long") * 1_000_000_000 + F.col("card.seq"),
    )


@operator("union_hero")
def union_hero(pages: DataFrame) -> DataFrame:
    """Products standing in hero, featured, banner, carousel and collection sections, in that order."""
    blocks = relations.page_blocks(pages)
    cards, links = products.product_blocks(blocks), _links_in(blocks)
    card, around = F.col("card"), F.col("owners")
    in_hero = dom.selector_rank(rules.HERO_ITEM_SELECTORS, card, around)
    in_featured = dom.selector_rank(rules.FEATURED_ITEM_SELECTORS, card, around)
    from_cards = (
        _placed(cards, ("hero",), in_hero)
        .unionByName(_placed(cards, ("featured", "carousel"), in_featured))
        .unionByName(_placed(cards, ("collection",), F.when(
            card["cls"].contains("product")
            & F.exists("owners", lambda o: (o["seq"] > F.col("owner.seq")) & o["cls"].contains("collection")), 0)))
    )
    # Links come after the blocks of their section.
    from_links = _placed(links, ("hero", "banner"), F.lit(99))
    linked = products.product_from_link(
        from_links.select(
            *PAGE, "seq", F.col("branch").alias("spot_branch"),
            dom.attr(F.col("card.opener"), "href").alias("href"),
            dom.element_text(F.col("card")).alias("text"),
            dom.attr(F.col("card.opener"), "title").alias("title"),
            dom.inner_html(F.col("card")).alias("inner"),
            F.lit(None).cast("string").alias("link_url"),
        ).withColumn("link_url", _absolute("href")),
        branch="spot_branch",
    )
    return products.card_fields(from_cards, "hero").unionByName(linked)


def _absolute(column: str) -> Column:
    from storelens.functions import urls

    return urls.resolve_url(F.col(column), relations.base_url(F.col("url")))


@operator("hero_position")
def hero_position(pages: DataFrame, n: int = rules.HERO_LIMIT) -> DataFrame:
    """Featured products by place on the page: 100 minus index, plus points for completeness; best six."""
    unique = dedup_products(union_hero(pages), order=ORDER)
    # A product's index only matters while it can still reach the best n: completeness adds at most
    # 45 points, so rows past 45 + n places can never be chosen and are cut before the window.
    near = limit_per_site(unique, 46 + n, order=ORDER)
    index = F.row_number().over(Window.partitionBy("site").orderBy(*ORDER)) - 1
    scored = near.withColumn("score", 100 - index + _completeness(image=20, price=15, description=10))
    return limit_per_key(scored, ["site"], [F.col("score").desc(), *ORDER], n, rank="hero_rank")


@operator("hero_products")
def hero_products(
    catalog: DataFrame, pages: DataFrame | None = None, *, hero_tags=rules.HERO_TAGS, rank: str = "catalog"
) -> DataFrame:
    """Featured products per site: tagged ones, else by page position.

    At most ten when any carries the homepage tag, six otherwise.  ``rank='relevance'`` orders the
    tagged ones by score instead of catalog order.
    """
    scored = hero_relevance(catalog, hero_tags)
    order = [F.col("score").desc(), *ORDER] if rank == "relevance" else ["tag_rank", *ORDER]
    top = limit_per_key(scored, ["site"], order, rules.HOMEPAGE_HERO_LIMIT, rank="hero_rank")
    any_home = F.min("tag_rank").over(Window.partitionBy("site")) == 0
    tagged = top.withColumn("any_home", any_home).filter(F.col("any_home") | (F.col("hero_rank") <= rules.HERO_LIMIT))
    columns = (*products.COLUMNS, "hero_rank")
    tagged = tagged.select(*columns)
    if pages is None:
        return tagged
    placed = hero_position(pages).select(*columns)
    return tagged.unionByName(placed.join(tagged.select("site").distinct(), "site", "left_anti"))


@operator("hero_catalog_html")
def hero_catalog_html(feed_products: DataFrame, pages: DataFrame, n: int = rules.CATALOG_LIMIT) -> DataFrame:
    """Source of featured products: the feed, or at most 100 page products where the feed gives none."""
    from_pages = limit_per_site(products.union_products(pages), n)
    return products.catalog_with_fallback(feed_products, from_pages)
