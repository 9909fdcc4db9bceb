"""Base relations: narrow rows taken from page snapshots.

Input is ``pages(url, html[, fetched_at])``.  All work happens in the scan
stage; raw HTML is never shuffled.  ``site`` is the lowercase host and
``(page_rank, url, seq)`` orders everything within a site: home page first,
then by depth and URL, then by position on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom, text, urls
from storelens.functions.outline import outline
from storelens.operators.registry import operator

PAGE = ("site", "url", "page_rank")
# What stands in a tag up to its end; a ">" in quotes doesn't end it, unless the quote has no end.
TAG_REST = r"""(?:(?:[^'">]++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)"""
LD_PATTERN = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"


@operator("read_pages")
def with_site(pages: DataFrame) -> DataFrame:
    """Add ``site`` and ``page_rank``; drop pages without text or without a valid URL."""
    if "site" in pages.columns:
        return pages
    return (
        pages.filter((F.col("html") != "") & urls.valid_url(F.col("url")))
        .withColumn("site", urls.host_of(F.col("url")))
        .withColumn("page_rank", urls.page_rank(F.col("url")))
    )


def base_url(url: Column) -> Column:
    return urls.normalize_site_url(url)


def link_array(body: Column, url: Column) -> Column:
    """Anchors with a target in page markup, in page order, as an array of structs.

    Built in steps, each over the fields of the step before, so no regex runs twice per anchor.
    """
    pieces = F.split(body, r"(?i)<a(?=[\s>])")
    body = rf"(?is)^({TAG_REST})>(.*?)(?:</a\b|\z)"
    raw = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda piece, i: F.struct(
            i.alias("seq"),
            F.regexp_extract(piece, body, 1).alias("opener"),
            F.regexp_extract(piece, body, 2).alias("inner"),
        ),
    )
    read = F.transform(
        raw,
        lambda a: F.struct(
            a["seq"].alias("seq"),
            dom.attr(a["opener"], "href").alias("href"),
            text.strip_tags(a["inner"]).alias("text"),
            dom.attr(a["opener"], "title").alias("title"),
            dom.attr(a["opener"], "class").alias("cls"),
            F.when(a["inner"].contains("<"), a["inner"]).alias("inner"),
        ),
    )
    with_target = F.filter(read, lambda a: a["href"].isNotNull())
    return F.transform(
        with_target,
        lambda a: F.struct(
            a["seq"].alias("seq"),
            a["href"].alias("href"),
            urls.resolve_url(a["href"], base_url(url)).alias("link_url"),
            a["text"].alias("text"),
            a["title"].alias("title"),
            a["cls"].alias("cls"),
            a["inner"].alias("inner"),
        ),
    )


# An anchor's opening tag; like the pieces that ``link_array`` reads, it ends before the next anchor begins. No letter but the "a"
# stands in it, so it needs no flag for any case, which makes every class of characters dearer.
NO_ANCHOR = r"<(?![aA][\s>])"
ANCHOR = (
    rf"""(?s)<[aA](?=[\s>])((?:[^'"><]++|{NO_ANCHOR}|"(?:[^"<]++|{NO_ANCHOR})*+"|'(?:[^'<]++|{NO_ANCHOR})*+')*+(?=>)|(?:[^><]++|{NO_ANCHOR})*+)>"""
)


def first_hrefs(html: Column, cls: Column, most: Column) -> Column:
    """Targets of the first ``most`` anchors of a page that have one and the class, as written and in page order; any class where ``cls`` is empty.

    Comments, scripts and styles are only looked for where one may begin. Targets are read of the first anchors of the class, and of
    all of them only where one of the first has none.
    """

    def classed(opener):
        # Without a reference there is nothing to decode.
        held = F.when(opener.contains("&"), F.coalesce(dom.attr(opener, "class"), F.lit(""))).otherwise(dom.bare_attr(opener, "class"))
        return F.concat(F.lit(" "), held, F.lit(" ")).contains(F.concat(F.lit(" "), cls, F.lit(" ")))

    def read(openers):
        return F.filter(F.transform(openers, lambda o: dom.bare_attr(o, "href")), lambda h: h != "")

    hidden = html.contains("<!--") | html.contains("<s") | html.contains("<S")
    body = F.when(hidden, text.markup(html)).otherwise(html)
    openers = F.filter(F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1)), lambda o: (cls == "") | classed(o))

    def cut(found):
        first = F.slice(found, F.lit(1), most)
        return text.let(read(first), lambda h: F.when(F.size(h) == F.size(first), h).otherwise(F.slice(read(found), F.lit(1), most)))

    return text.let(openers, cut)


@operator("links")
def links(pages: DataFrame) -> DataFrame:
    """Every ``<a href>``: raw target, absolute URL, text, title, class, content, order."""
    if "links" in pages.columns:
        return pages.select(*PAGE, F.inline("links"))
    # Exploding the expression itself, not a column of it: a column would get a non-empty filter that
    # is pushed to the scan and reads every page a second time.
    return with_site(pages).select(*PAGE, F.inline(link_array(text.markup(F.col("html")), F.col("url"))))


def ld_entries(pages: DataFrame) -> Column:
    """Entries of a page's JSON-LD blocks as an array of VARIANT."""
    blocks = F.col("ld_blocks") if "ld_blocks" in pages.columns else F.regexp_extract_all("html", F.lit(LD_PATTERN), F.lit(1))
    docs = F.filter(F.transform(blocks, F.try_parse_json), lambda d: d.isNotNull())
    return F.flatten(F.call_function("transform", docs, F.expr("d -> coalesce(try_variant_get(d, '$', 'array<variant>'), array(d))")))


@operator("structured_items")
def structured_items(pages: DataFrame) -> DataFrame:
    """JSON-LD blocks as VARIANT; a top-level array gives one row per entry, bad JSON none. ``seq`` counts a page's entries."""
    entries, staged = ld_entries(pages), "ld_blocks" in pages.columns
    found = (pages if staged else with_site(pages)).select(*PAGE, F.posexplode(entries).alias("seq", "item"))
    return found.select(*PAGE, F.col("seq").cast("long").alias("seq"), "item")


@operator("images")
def images(pages: DataFrame) -> DataFrame:
    """Every ``<img>``: src, data-src, data-original, alt, and the first usable absolute URL."""
    tags = F.regexp_extract_all(text.markup(F.col("html")), F.lit(rf"(?is)<img\b{TAG_REST}>"), F.lit(0))
    found = with_site(pages).select(*PAGE, F.posexplode(tags).alias("seq", "opener"))
    return found.select(
        *PAGE,
        "seq",
        dom.attr(F.col("opener"), "src").alias("src"),
        dom.attr(F.col("opener"), "data-src").alias("data_src"),
        dom.attr(F.col("opener"), "data-original").alias("data_original"),
        dom.attr(F.col("opener"), "alt").alias("alt"),
        urls.resolve_url(
            dom.first_attr(F.col("opener"), "data-src", "src", "data-original"), base_url(F.col("url"))
        ).alias("image_url"),
    )


@operator("forms")
def forms(pages: DataFrame) -> DataFrame:
    """Every ``<form>`` with its action."""
    tags = F.regexp_extract_all(text.markup(F.col("html")), F.lit(rf"(?is)<form\b{TAG_REST}>"), F.lit(0))
    found = with_site(pages).select(*PAGE, F.posexplode(tags).alias("seq", "opener"))
    return found.select(*PAGE, "seq", dom.attr(F.col("opener"), "action").alias("action"))


@operator("headings")
def headings(pages: DataFrame) -> DataFrame:
    """h1-h6 with the text of what follows up to the next heading."""
    pieces = F.split(text.markup(F.col("html")), r"(?i)<h(?=[1-6]\b)")
    following = F.slice(pieces, F.lit(2), F.size(pieces))
    body = rf"(?is)^([1-6]){TAG_REST}>(.*?)(?:</h[1-6]\s*>|\z)(.*)$"
    found = with_site(pages).select(*PAGE, F.posexplode(following).alias("seq", "piece"))
    return found.select(
        *PAGE,
        "seq",
        F.regexp_extract("piece", body, 1).try_cast("int").alias("level"),
        text.strip_tags(F.regexp_extract("piece", body, 2)).alias("heading"),
        text.strip_tags(F.regexp_extract("piece", body, 3)).alias("block"),
    )


@operator("page_text")
def page_text(pages: DataFrame, *, drop_regions: bool = False) -> DataFrame:
    """Visible text of every page."""
    body = text.visible_text(F.col("html"), drop_regions=drop_regions)
    return with_site(pages).select(*PAGE, body.alias("text"))


def meta_content(html: Column, key: str, value: str) -> Column:
    """``content`` of the first ``<meta>`` whose ``key`` attribute is ``value``."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b{TAG_REST}>"), F.lit(0))
    named = text.first_of(tags, lambda t: t.rlike(rf"(?is)\b{key}\s*=\s*[\"']?{value}[\"'\s/>]"))
    return dom.attr(named, "content")


def title_text(html: Column) -> Column:
    return text.blank_to_null(text.strip_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)))


@operator("page_meta")
def page_meta(pages: DataFrame) -> DataFrame:
    """Title, meta description, og:site_name, og:description."""
    html = F.col("html")
    return with_site(pages).select(
        *PAGE,
        title_text(html).alias("title"),
        meta_content(html, "name", "description").alias("description"),
        meta_content(html, "property", "og:site_name").alias("site_name"),
        meta_content(html, "property", "og:description").alias("og_description"),
    )


def lead(html: Column) -> Column:
    paragraphs = F.slice(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p\b|<p\b|\z)"), F.lit(1)), 1, 3)
    return F.concat_ws(
        " ",
        meta_content(html, "name", "description"),
        title_text(html),
        text.blank_to_null(text.strip_tags(F.array_join(paragraphs, " "))),
    )


@operator("lead_text")
def lead_text(pages: DataFrame) -> DataFrame:
    """Meta description, title and first three paragraphs."""
    return with_site(pages).select(*PAGE, lead(text.markup(F.col("html"))).alias("lead"))


def script_value(html: Column, name: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"{name}\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


@operator("script_vars")
def script_vars(pages: DataFrame) -> DataFrame:
    """Shop domain and currency set in page scripts; the last one wins."""
    html = F.col("html")
    return with_site(pages).select(
        *PAGE,
        script_value(html, r"Shopify\.shop").alias("shop_domain"),
        script_value(html, r"Shopify\.currency").alias("script_currency"),
    )


def platform_flag(html: Column, url: Column, marks=rules.PLATFORM_MARKS) -> Column:
    lowered = F.lower(html)
    return url.contains(rules.PLATFORM_URL_MARK) | text.any_of(lowered.contains(m.lower()) for m in marks)


@operator("detect_platform")
def detect_platform(pages: DataFrame, marks=rules.PLATFORM_MARKS) -> DataFrame:
    """Flag pages of the hosted store platform; nothing is dropped."""
    return with_site(pages).select(*PAGE, platform_flag(F.col("html"), F.col("url"), marks).alias("on_platform"))


@operator("detect_platform_loose")
def detect_platform_loose(pages: DataFrame, marks=rules.PLATFORM_MARKS_LOOSE) -> DataFrame:
    """Looser page test for candidates; also looks at response headers when there is a ``headers`` map."""
    lowered = F.lower("html")
    flag = text.any_of(lowered.contains(m) for m in marks)
    if "headers" in pages.columns:
        names = F.transform(F.map_keys("headers"), F.lower)
        flag = flag | F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, rules.PLATFORM_HEADERS))), F.lit(False))
    return with_site(pages).select(*PAGE, flag.alias("on_platform"))


# Elements any block rule looks at.  The words are searched in opening tags.
WITHIN_TAGS = ("a", "img", "p", "button", "summary", "span", "option", "dt", "dd")
WANTED = (
    r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*(?:product|faq|question|help|address|currency|logo|brand|header|hero"
    r"|slideshow|featured|best-sellers|trending|banner|carousel|slider|swiper|collection|accordion|toggle|collaps"
    r"|expand|policy|legal|page-content|main-content|page-title|(?<![\w-])content(?![\w-])|(?<![\w-])rte(?![\w-]))"
    r"|\bdata-(?:product|section-type|slick|carousel|availability|price)"
    r"|<(?:dl|main|article)\b|<img\b[^>]*logo"
)
PARTS = r"<main\b|\bclass\s*=\s*[\"'][^\"']*(?:policy-content|legal-content|page-content|main-content|content|rte)"
POLICY_WORDS = "|".join(w for _, _, words in rules.POLICY_HEADING_RULES for w in words)
MAY_HOLD_BLOCKS = f"(?is){WANTED}|{POLICY_WORDS}"


def page_outline(html: Column) -> Column:
    """Outline of the elements the block rules need; NULL for pages without any.

    A JVM regex picks the pages that may hold a block; only their text goes to the Arrow UDF.
    """
    text_to_read = F.when(html.rlike(MAY_HOLD_BLOCKS), text.markup(html))
    return outline(text_to_read, WANTED, within=WITHIN_TAGS, heading_words=POLICY_WORDS, with_parts=PARTS)


def with_dom(pages: DataFrame, *columns) -> DataFrame:
    """The columns with the page's outline: its elements as ``dom`` and the pieces of its markup that they span."""
    read = pages.select(*columns, page_outline(F.col("html")).alias("outline"))
    return read.select(*read.columns[:-1], F.col("outline.elements").alias("dom"), F.col("outline.pieces").alias("pieces"))


@operator("sections")
def page_blocks(pages: DataFrame) -> DataFrame:
    """One row per page that holds blocks, with its elements in ``dom`` and its markup in ``pieces``."""
    if "dom" not in pages.columns:
        pages = with_dom(with_site(pages), *PAGE)
    return pages.filter(F.size("dom") > 0).select(*PAGE, "dom", "pieces")


@operator("elements")
def elements(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """Flat form of the outline: one row per element, optionally only those matching a selector."""
    found = page_blocks(pages).select(*PAGE, "pieces", F.explode("dom").alias("e"))
    if selector:
        found = found.filter(dom.matches(F.col("e"), selector))
    return found.select(
        *PAGE, F.col("e.seq").alias("seq"), F.col("e.tag").alias("tag"), F.trim(F.col("e.cls")).alias("cls"),
        dom.element_text(F.col("e")).alias("text"),
    )
