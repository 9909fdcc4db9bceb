"""Product records from feeds, structured data, cards and links.

Every operator returns flat rows: ``site, url, page_rank, branch, seq`` and the
product columns.  ``branch`` orders the sources of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom, text, urls
from storelens.operators import relations
from storelens.operators.ranking import dedup_products, first_per_key, limit_per_key
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

ORDER = ("branch", "page_rank", "url", "seq")
PRODUCT = (
    "name", "price", "price_text", "original_price", "original_price_text", "currency",
    "in_stock", "image_url", "product_url", "description", "tags",
)
COLUMNS = (*PAGE, "branch", "seq", *PRODUCT)

# Branches of a page in order of preference.
JSONLD, GRID, LIST, SECTION, COLLECTION = range(5)


def as_products(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the product columns, typing price texts and filling what a source lacks with NULL."""
    missing = F.lit(None).cast("string")
    for name in ("price_text", "original_price_text", "currency", "image_url", "product_url", "description"):
        columns.setdefault(name, missing)
    columns.setdefault("in_stock", F.lit(True))
    columns.setdefault("tags", F.lit(None).cast("array<string>"))
    typed = df.select(*PAGE, F.col("branch").cast("int").alias("branch"), F.col("seq").cast("long").alias("seq"),
                      *[c.alias(n) for n, c in columns.items()])
    return typed.select(
        *PAGE, "branch", "seq", "name",
        text.price_amount(F.col("price_text")).alias("price"), "price_text",
        text.price_amount(F.col("original_price_text")).alias("original_price"), "original_price_text",
        "currency", "in_stock", "image_url", "product_url", "description", "tags",
    )


def product_struct() -> Column:
    return F.struct(*PRODUCT)


# ---------------------------------------------------------------- feeds


@operator("products_from_feed")
def products_from_feed(
    feed: DataFrame, *, style: str = "default", tag_limit: int = 10, desc_limit: int | None = None
) -> DataFrame:
    """Products of parsed feed rows (see ``sources.feeds.read_product_feed``).

    ``default`` keeps texts as they are and cuts the description at 500 characters; ``hero`` cleans name
    and description (cut at 200), lower-cases tags and resolves the image URL.
    """
    hero = style == "hero"
    desc_limit = desc_limit or (200 if hero else 500)
    variant, src_of = F.get("product.variants", F.lit(0)), F.get("product.images", F.lit(0)).getField("src")
    first = feed.select(
        *PAGE, "base_url", "seq", "product",
        variant.alias("variant"),
        text.blank_to_null(variant["price"]).alias("price"),
        text.blank_to_null(variant["compare_at_price"]).alias("compare"),
        text.blank_to_null(src_of).alias("src"),
        F.expr("coalesce(try_variant_get(product.tags, '$', 'array<string>'),"
               " split(try_variant_get(product.tags, '$', 'string'), ','))").alias("raw_tags"),
    )
    price, compare = F.col("price"), F.col("compare")
    # A reduced price that is not a number makes the whole product unusable.
    broken = compare.isNotNull() & (
        compare.try_cast("double").isNull() | (price.isNotNull() & price.try_cast("double").isNull())
    )
    name, handle = F.col("product.title"), text.blank_to_null(F.col("product.handle"))
    kept_tags = F.slice("raw_tags", 1, tag_limit)
    tags = F.transform(kept_tags, lambda t: F.lower(F.trim(t)) if hero else F.trim(t))
    tags = F.when(F.size("raw_tags") > 0, tags)
    body = text.blank_to_null(F.col("product.body_html"))
    src = F.col("src")
    reduced = compare.try_cast("double") > F.coalesce(price.try_cast("double"), F.lit(0.0))
    usable = first.filter((F.coalesce(name, F.lit("")) != "") & ~F.coalesce(broken, F.lit(False)))
    return as_products(
        usable.withColumn("branch", F.lit(0)),
        name=text.clean_text(name) if hero else name,
        price_text=F.concat(F.lit("$"), price),
        original_price_text=F.when(reduced, F.concat(F.lit("$"), compare)),
        in_stock=F.when(F.col("variant").isNull(), True).otherwise(F.coalesce("variant.available", F.lit(True))),
        image_url=urls.resolve_url(src, F.col("base_url")) if hero else src,
        product_url=F.concat(F.col("base_url"), F.lit("/products/"), handle),
        description=F.substring(text.clean_text(body) if hero else body, 1, desc_limit),
        tags=tags,
    )


# ---------------------------------------------------------------- structured data


def _variant_text(path: str) -> Column:
    return F.expr(f"try_variant_get(item, '{path}', 'string')")


@operator("products_from_jsonld")
def products_from_jsonld(items: DataFrame, *, style: str = "default") -> DataFrame:
    """``@type: Product`` entries.  ``legacy`` writes ``CUR price``, knows no default currency and
    leaves availability open when the entry does not state it."""
    found = items.filter(_variant_text('$["@type"]') == "Product").select(
        *PAGE,
        "seq",
        _variant_text("$.name").alias("raw_name"),
        F.coalesce(_variant_text("$.offers[0].price"), _variant_text("$.offers.price")).alias("raw_price"),
        F.coalesce(_variant_text("$.offers[0].priceCurrency"), _variant_text("$.offers.priceCurrency")).alias("cur"),
        F.coalesce(
            _variant_text("$.offers[0].availability"), _variant_text("$.offers.availability"), F.lit("")
        ).alias("stock"),
        F.coalesce(
            _variant_text("$.image[0]"), _variant_text("$.image.url"),
            F.when(~_variant_text("$.image").rlike(r"^[\[{]"), _variant_text("$.image")),
        ).alias("image"),
        text.blank_to_null(_variant_text("$.url")).alias("link"),
        text.blank_to_null(_variant_text("$.description")).alias("about"),
    ).filter(F.col("raw_name") != "").withColumn("branch", F.lit(JSONLD))
    # A price of 0 or an empty text counts as none.
    none = (F.col("raw_price") == "") | F.coalesce(F.col("raw_price").try_cast("double") == 0, F.lit(False))
    found = found.withColumn("offer", F.when(~none, F.col("raw_price")))
    price = F.col("offer")
    image = urls.resolve_url(text.blank_to_null(F.col("image")), relations.base_url(F.col("url")))
    common = {
        "name": text.clean_text(F.col("raw_name")),
        "image_url": image,
        "description": text.clean_text(F.col("about")),
    }
    if style == "legacy":
        return as_products(
            found,
            **common,
            price_text=F.coalesce(F.concat_ws(" ", F.when(price.isNotNull(), F.col("cur")), price), price),
            currency=F.col("cur"),
            in_stock=F.when(F.col("stock").contains("InStock"), True).when(F.col("stock").contains("OutOfStock"), False),
        )
    currency = F.coalesce("cur", F.lit("USD"))
    return as_products(
        found,
        **common,
        price_text=text.format_price(price, currency),
        currency=F.when(price.isNotNull(), currency),
        in_stock=~F.lower("stock").contains("outofstock"),
        product_url=urls.resolve_url(F.col("link"), relations.base_url(F.col("url"))),
    )


@operator("products_from_jsonld_legacy")
def products_from_jsonld_legacy(items: DataFrame) -> DataFrame:
    return products_from_jsonld(items, style="legacy")


# ---------------------------------------------------------------- cards

_CARD_STYLES = {
    "default": (rules.CARD_NAME_SELECTORS, rules.CARD_PRICE_SELECTORS, rules.CARD_ORIGINAL_PRICE_SELECTORS, 200),
    "hero": (rules.HERO_NAME_SELECTORS, rules.CARD_PRICE_SELECTORS, rules.CARD_ORIGINAL_PRICE_SELECTORS, 150),
    "legacy": (rules.LEGACY_NAME_SELECTORS, rules.LEGACY_PRICE_SELECTORS, rules.LEGACY_ORIGINAL_PRICE_SELECTORS, 0),
}


def product_blocks(blocks: DataFrame, firsts=()) -> DataFrame:
    """One row per product-like element: the element, what is inside it, what is around it.

    With ``firsts``, ``first_of`` is the index of the first of these selectors that it matches, if no element before it has that index.
    """
    page = F.col("dom")
    like = F.filter(
        page,
        lambda e: e["cls"].contains("product") | dom.has_attr(e["opener"], r"data-product[\w-]*")
        | dom.matches(e, "#product"),
    )

    def cards(elements):
        return F.transform(
            elements,
            lambda e: F.struct(e.alias("card"), dom.inside(page, e).alias("parts"), dom.owners(page, e).alias("owners")),
        )

    if not firsts:
        return blocks.select(*PAGE, "pieces", F.inline(cards(like))).withColumn("seq", F.col("card.seq"))
    read = blocks.select(*PAGE, "pieces", cards(like).alias("cards"))
    ranks = F.transform("cards", lambda c: dom.selector_rank(firsts, c["card"], c["owners"]))
    read = read.select(*PAGE, "pieces", "cards", ranks.alias("ranks"))
    first = F.transform("ranks", lambda r, i: F.when(F.array_position(F.col("ranks"), r) == i + 1, r))
    read = read.select(*PAGE, "pieces", F.inline(F.arrays_zip("cards", first.alias("first_of"))))
    return read.select(*PAGE, "pieces", "cards.*", "first_of").withColumn("seq", F.col("card.seq"))


def _field(selectors, accept) -> Column:
    """Text of the first selector whose first element has an acceptable text."""
    return text.first_of(dom.first_texts(F.col("parts"), selectors), accept)


def availability_text(stock_texts: Column, disabled: Column | None = None) -> Column:
    """True unless a stock text says 'out' or 'sold', or the add-to-cart button is disabled.

    The first text of the array that says anything decides.
    """

    def said(t):
        return F.when(t.rlike("out|sold"), False).when(t.rlike("in stock|available"), True)

    verdicts = F.array_compact(F.transform(stock_texts, lambda t: said(F.lower(t))))
    button = [F.when(disabled, False)] if disabled is not None else []
    return F.coalesce(F.get(verdicts, F.lit(0)), *button, F.lit(True))


def card_fields(blocks: DataFrame, style: str = "default") -> DataFrame:
    """Product columns of product blocks (needs ``card``, ``parts``, ``owners``, ``branch``, ``seq``)."""
    names, prices, originals, desc_limit = _CARD_STYLES[style]
    base, image, link = relations.base_url(F.col("url")), F.col("image"), F.col("link")
    blocks = blocks.select(
        *PAGE, "branch", "seq", "card", "parts", "pieces",
        dom.first_match(F.col("parts"), "img")["opener"].alias("image"),
        dom.attr(dom.first_match(F.col("parts"), "a")["opener"], "href").alias("link"),
    )
    if style == "legacy":
        fields = {
            "name": text.clean_text(_field(names, lambda t: t != "")),
            "price_text": text.extract_price(_field(prices, lambda t: t != "")),
            "currency": text.price_currency(text.extract_price(_field(prices, lambda t: t != ""))),
            "original_price_text": text.extract_price(_field(originals, lambda t: t != "")),
            "image_url": urls.resolve_url(dom.first_attr(image, "src", "data-src"), base),
            "product_url": urls.resolve_url(link, base),
            "in_stock": ~text.strip_tags(dom.inner_html(F.col("card"))).rlike(rules.LEGACY_UNAVAILABLE_PATTERN),
        }
        return as_products(blocks, **fields).filter(F.col("name") != "")

    def sign(t):
        return t.rlike("[$€£]")

    stock = dom.first_texts(F.col("parts"), rules.CARD_AVAILABILITY_SELECTORS)
    cart = F.exists("parts", lambda e: (e["tag"] == "button") & e["cls"].rlike("add.*cart|cart.*add")
                    & dom.has_attr(e["opener"], "disabled"))
    product_link = F.coalesce(
        F.when(link.contains("/products/"), link), dom.attr(F.col("card.opener"), "data-product-url")
    )
    fields = {
        "name": text.clean_text(_field(names, lambda t: F.length(t) > 2)),
        "price_text": text.clean_text(_field(prices, sign)),
        "original_price_text": text.clean_text(_field(originals, sign)),
        "currency": text.price_currency(_field(prices, sign)),  # the price text loses its sign
        "image_url": urls.resolve_url(dom.first_attr(image, "data-src", "src", "data-original"), base),
        "product_url": urls.resolve_url(product_link, base),
        "in_stock": availability_text(stock, cart if style == "default" else None),
        "description": F.substring(
            text.clean_text(_field(rules.CARD_DESCRIPTION_SELECTORS, lambda t: F.length(t) > 10)), 1, desc_limit
        ),
    }
    if style == "default":
        fields["tags"] = _card_tags()
    return as_products(blocks, **fields).filter(F.col("name") != "")


def _card_tags() -> Column:
    """Cleaned tag texts inside the card, by selector; the tag's own owners are looked up in the card."""
    around = "filter(parts, x -> x.seq < e.seq and x.last >= e.seq)"
    found = ", ".join(f"filter(parts, e -> {dom.path_test(s, 'e', around)})" for s in rules.CARD_TAG_SELECTORS)
    shown = F.transform(F.expr(f"concat({found})"), lambda e: text.clean_text(text.strip_tags(dom.inner_html(e))))
    return text.let(F.filter(shown, lambda t: t != ""), lambda tags: F.when(F.size(tags) > 0, tags))


@operator("products_from_cards")
def products_from_cards(pages: DataFrame, *, style: str = "default") -> DataFrame:
    """Products of card-like blocks.

    ``default`` ranks a block by the best branch it belongs to: grid selectors, any element with
    'product' in its class, sections marked as product or collection, collection pages.
    ``legacy`` takes the blocks of the first selector that matches anything on the page.
    """
    blocks = product_blocks(relations.page_blocks(pages))
    card, around = F.col("card"), F.col("owners")
    if style == "legacy":
        ranked = blocks.withColumn("pick", dom.selector_rank(rules.LEGACY_CARD_SELECTORS, card, around))
        best = F.min("pick").over(Window.partitionBy("site", "url"))
        chosen = ranked.filter(F.col("pick").isNotNull()).withColumn("best", best).filter("pick = best")
        return card_fields(chosen.withColumn("branch", F.lit(GRID)), "legacy")
    # Within the grid branch the selector decides before the position on the page.
    ordered = _branched(blocks).withColumn("seq", _grid_order())
    return card_fields(ordered.filter(F.col("branch").isNotNull()), style)


def _grid_order() -> Column:
    return F.coalesce("pick", F.lit(0)).cast("long") * 1_000_000_000 + F.col("seq")


def _branched(blocks: DataFrame) -> DataFrame:
    """Product blocks with the grid selector they match (``pick``) and the best branch they belong to, NULL for none."""
    card, around = F.col("card"), F.col("owners")
    section = F.exists(
        around, lambda o: F.coalesce(F.lower(dom.raw_attr(o["opener"], "data-section-type")).rlike("product|collection"),
                                     F.lit(False))
    ) & dom.selector_rank(rules.SECTION_ITEM_SELECTORS, card, around).isNotNull()
    return blocks.withColumn("pick", dom.selector_rank(rules.GRID_SELECTORS, card, around)).withColumn(
        "branch",
        F.when(F.col("pick").isNotNull(), GRID)
        .when(card["cls"].contains("product"), LIST)
        .when(section, SECTION)
        .when(dom.selector_rank(rules.COLLECTION_SELECTORS, card, around).isNotNull(), COLLECTION),
    )


@operator("product_from_link")
def product_from_link(links: DataFrame, *, branch: str | None = None) -> DataFrame:
    """Products named only by a ``/products/`` link: its text, title, or the words of its handle."""
    found = links.filter(F.col("href").contains("/products/"))
    handle = F.regexp_extract("href", r"/products/([^?#]*)", 1)
    image = F.regexp_extract("inner", rf"(?is)<img\b{relations.TAG_REST}>", 0)
    return as_products(
        found.withColumn("branch", F.col(branch) if branch else F.lit(LIST)),
        name=text.clean_text(
            F.coalesce(text.blank_to_null(F.col("text")), F.col("title"), F.initcap(F.replace(handle, F.lit("-"), F.lit(" "))))
        ),
        product_url=F.col("link_url"),
        image_url=urls.resolve_url(
            dom.first_attr(image, "data-src", "src", "data-original"), relations.base_url(F.col("url"))
        ),
    ).filter(F.col("name") != "")


@operator("union_products")
def union_products(pages: DataFrame) -> DataFrame:
    """All product sources of the pages in branch order, deduplicated per site."""
    structured = products_from_jsonld(relations.structured_items(pages))
    cards = products_from_cards(pages)
    return dedup_products(structured.unionByName(cards))


def _limited(df: DataFrame, keys, order, n: int | None) -> DataFrame:
    return df if n is None else limit_per_key(df, keys, order, n)


def page_products(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Per page: products of all branches, deduplicated, at most ``n`` if one is given."""
    both = products_from_jsonld(relations.structured_items(pages)).unionByName(products_from_cards(pages))
    both = both.repartition("site", "url")  # serves both windows below; a page is a small group
    unique = first_per_key(both, ["site", "url", F.lower("name"), F.coalesce("product_url", F.lit(""))], ["branch", "seq"])
    return _limited(unique, ["site", "url"], ["branch", "seq"], n)


# Branches of a main block come before those of the page; the words that its selectors need in a page, attributes in any case.
_MAIN = len(rules.SINGLE_PRODUCT_SELECTORS)
MAY_HOLD_MAIN = "|".join(
    rf"{'(?i)' if s[0] == '[' else '(?-i)'}(?<![\w-]){s.strip('.#[]')}(?![\w-])" for s in rules.SINGLE_PRODUCT_SELECTORS
)


def _names_product(entries: Column) -> Column:
    """Whether ``products_from_jsonld`` finds a product among a page's entries."""
    return F.call_function("exists", entries, F.expr(
        """item -> coalesce(try_variant_get(item, '$["@type"]', 'string') = 'Product' and try_variant_get(item, '$.name', 'string') <> '', false)"""
    ))


@operator("single_product")
def single_product(pages: DataFrame) -> DataFrame:
    """The product of a product page: its main block when that names one, else the page's first product."""
    pages = relations.with_site(pages)
    structured = products_from_jsonld(relations.structured_items(pages))
    # Blocks are only read where they can decide: a main block may be there, or structured data names no product.
    may_hold_main = F.col("html").rlike(MAY_HOLD_MAIN) if "html" in pages.columns else F.lit(True)
    undecided = ~_names_product(relations.ld_entries(pages)) | may_hold_main
    blocks = _branched(product_blocks(relations.page_blocks(pages.filter(undecided)), rules.SINGLE_PRODUCT_SELECTORS))
    main, listed = F.struct(F.col("first_of").alias("branch"), "seq"), F.struct((F.col("branch") + _MAIN).alias("branch"), _grid_order().alias("seq"))
    places = F.array(F.when(F.col("first_of").isNotNull(), main), F.when(F.col("branch").isNotNull(), listed))
    placed = blocks.withColumn("place", F.explode(F.array_compact(places)))
    placed = placed.withColumn("branch", F.col("place.branch")).withColumn("seq", F.col("place.seq"))
    structured = structured.withColumn("branch", (F.col("branch") + _MAIN).cast("int"))
    return first_per_key(structured.unionByName(card_fields(placed)), ["site", "url"], ["branch", "seq"])


@operator("product_urls")
def product_urls(pages: DataFrame, sitemap: DataFrame | None = None, n: int | None = rules.PRODUCT_URL_LIMIT) -> DataFrame:
    """Product page URLs per site: from the first collection page that has any, the main page and the sitemap."""
    path = urls.path_of(F.col("url"))
    rank = F.when(F.col("page_rank") == 0, -1)
    for i, p in enumerate(rules.COLLECTION_PATHS):
        rank = rank.when(path == p, i)
    links = relations.links(pages).filter(F.col("href").contains("/products/"))
    found = links.select("site", F.col("link_url").alias("product_url"), rank.alias("rank")).filter(
        F.col("rank").isNotNull()
    ).distinct()
    best = found.filter("rank >= 0").groupBy("site").agg(F.min("rank").alias("best"))
    kept = found.join(best, "site", "left").filter("rank = -1 or rank = best").select("site", "product_url")
    if sitemap is not None:
        kept = kept.unionByName(sitemap.select("site", F.col("loc").alias("product_url")))
    return _limited(kept.distinct(), ["site"], ["product_url"], n)


@operator("catalog_with_fallback")
def catalog_with_fallback(feed_products: DataFrame, html_products: DataFrame) -> DataFrame:
    """Feed products; for sites whose feed gives none, the page products."""
    listed = feed_products.select("site").distinct()
    return feed_products.unionByName(html_products.join(listed, "site", "left_anti"))


@operator("fallback_products")
def fallback_products(
    pages: DataFrame, main: DataFrame, sitemap: DataFrame | None = None, *, main_limit: int | None = None,
    page_limit: int | None = None, per_page: int | None = None, url_limit: int | None = None,
) -> DataFrame:
    """Page products of a site without feed: those of its main page, then those of its product pages.

    ``main`` holds the main page of every site.  Product pages are those of the table that a link or the
    sitemap names; a scheme, ``www.``, query or trailing slash makes no difference.  Blocks are only read
    on these pages; the short product rows, not the pages, are then joined to the chosen URLs.  The
    limits cut products of the main page, product pages, products of each, and URLs looked at.
    """
    first = page_products(main, main_limit).withColumn("page_rank", F.lit(-1))
    product_pages = pages.filter(F.col("url").contains("/products/"))
    there = product_pages.select(urls.page_key(F.col("url")).alias("page_key")).distinct()
    wanted = product_urls(pages, sitemap, url_limit).withColumn("page_key", urls.page_key(F.col("product_url")))
    wanted = _limited(wanted.join(there, "page_key", "left_semi"), ["site"], ["product_url"], page_limit)
    found = page_products(product_pages, per_page).withColumn("page_key", urls.page_key(F.col("url")))
    detail = found.join(wanted.select("page_key").distinct(), "page_key", "left_semi").drop("page_key")
    return dedup_products(first.unionByName(detail), "exact", order=("page_rank", "url", "branch", "seq"))


@operator("total_products")
def total_products(catalog: DataFrame) -> DataFrame:
    """Catalog size per site."""
    return catalog.groupBy("site").agg(F.count("*").alias("total_products"))
