"""Brand facts and contacts of a page: name, description, logo, currencies, payments, address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom, text, urls
from storelens.operators import relations
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE


def _first_img(selector: str) -> Column:
    """First image, in page order, matching a selector such as ``.logo img``."""
    around = "filter(slice(dom, 1, e.seq - 1), x -> x.last >= e.seq)"
    return F.expr(f"get(filter(dom, e -> {dom.path_test(selector, 'e', around)}), 0).opener")


def with_outline(pages: DataFrame) -> DataFrame:
    """Pages with their outline next to the HTML; the outline is empty for pages without blocks."""
    base = relations.with_site(pages)
    if "dom" in base.columns:
        return base
    return relations.with_dom(base, *base.columns)


def logo_alt() -> Column:
    alts = F.array(*[dom.attr(_first_img(s), "alt") for s in rules.LOGO_ALT_SELECTORS])
    return text.first_of(alts, lambda a: (a != "") & ~F.lower(a).contains("logo"))


def short_title(title: Column) -> Column:
    """Title without a trailing ' - Shop ...' part, when shorter than 100 characters."""
    name = F.trim(F.regexp_replace(title, rules.TITLE_SUFFIX_PATTERN, ""))
    return text.let(name, lambda n: F.when((n != "") & (F.length(n) < 100), n))


def long_meta(*contents: Column) -> Column:
    return text.clean_text(text.first_of(F.array(*contents), lambda c: F.length(c) > 20))


@operator("brand_name")
def brand_name(meta: DataFrame) -> DataFrame:
    """Short title, else og:site_name, else the logo's alternative text when there is a ``logo_alt``."""
    sources = [short_title(F.col("title")), F.col("site_name")]
    if "logo_alt" in meta.columns:
        sources.append(F.col("logo_alt"))
    return meta.withColumn("brand_name", text.clean_text(F.coalesce(*sources)))


@operator("brand_description")
def brand_description(meta: DataFrame) -> DataFrame:
    """Meta description, else og:description, each longer than 20 characters."""
    return meta.withColumn("brand_description", long_meta(F.col("description"), F.col("og_description")))


def logo() -> Column:
    found = [dom.first_attr(_first_img(s), "src", "data-src") for s in rules.LOGO_SELECTORS]
    return F.coalesce(*found)


@operator("logo_url")
def logo_url(pages: DataFrame) -> DataFrame:
    """First logo image by selector, as an absolute URL."""
    found = relations.page_blocks(pages).select(*PAGE, logo().alias("src")).filter(F.col("src").isNotNull())
    return found.select(*PAGE, urls.resolve_url(F.col("src"), relations.base_url(F.col("url"))).alias("logo_url"))


def currency_codes() -> Column:
    """Three-letter codes in the options, links and spans of currency pickers."""
    pickers = F.filter("dom", lambda e: e["tag"].isin("select", "div") & dom.class_has(e, ("currency",)))
    options = F.flatten(
        F.transform(
            pickers,
            lambda p: F.filter(dom.inside(F.col("dom"), p), lambda e: e["tag"].isin("option", "a", "span")),
        )
    )
    codes = F.transform(options, lambda o: F.regexp_extract(text.strip_tags(dom.inner_html(o)), r"\b([A-Z]{3})\b", 1))
    return F.coalesce(F.filter(codes, lambda c: c != ""), F.array().cast("array<string>"))


@operator("currencies")
def currencies(pages: DataFrame) -> DataFrame:
    """Sorted currency codes of a page: the script currency and the currency pickers."""
    found = with_outline(pages).select(
        *PAGE,
        F.concat(
            F.array_compact(F.array(relations.script_value(F.col("html"), r"Shopify\.currency"))), currency_codes()
        ).alias("codes"),
    )
    return found.select(*PAGE, F.array_sort(F.array_distinct("codes")).alias("currencies"))


def payment_names(shown: Column, icons: Column, payment_rules=rules.PAYMENT_RULES, *, word_boundary=False) -> Column:
    """Sorted names of the payment indicators found in the lower-cased text or in any icon text."""

    def hit(word: str, name: str) -> Column:
        in_text = text.contains_any(shown, [word], word_boundary=word_boundary)
        return F.when(in_text | F.exists(icons, lambda t: t.contains(word)), F.lit(name))

    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[hit(*rule) for rule in payment_rules]))))


def payment_icons(html: Column) -> Column:
    """Sources and alternative texts of images whose source looks like a payment icon."""
    openers = F.regexp_extract_all(html, F.lit(rf"(?is)<img\b{relations.TAG_REST}>"), F.lit(0))
    read = F.transform(
        openers,
        lambda o: F.struct(
            F.coalesce(dom.attr(o, "src"), F.lit("")).alias("src"),
            F.coalesce(dom.attr(o, "alt"), F.lit("")).alias("alt"),
        ),
    )
    icons = F.filter(read, lambda i: i["src"].rlike(rules.PAYMENT_ICON_PATTERN))
    return F.transform(icons, lambda i: F.lower(F.concat_ws("\n", i["src"], i["alt"])))


@operator("payment_methods")
def payment_methods(pages: DataFrame, payment_rules=rules.PAYMENT_RULES, *, word_boundary=False) -> DataFrame:
    """Sorted payment methods named in the text or shown as icons."""
    body = text.markup(F.col("html"))
    read = relations.with_site(pages).select(
        *PAGE, F.lower(text.strip_tags(body)).alias("shown"), payment_icons(body).alias("icons")
    )
    names = payment_names(F.col("shown"), F.col("icons"), payment_rules, word_boundary=word_boundary)
    return read.select(*PAGE, names.alias("payment_methods"))


def address() -> Column:
    """Cleaned text of the first address block, by selector, when longer than 20 characters."""
    shown = dom.first_texts(F.col("dom"), rules.ADDRESS_SELECTORS)
    return text.clean_text(text.first_of(shown, lambda t: F.length(t) > 20))


def has_contact_form(html: Column) -> Column:
    openers = F.regexp_extract_all(html, F.lit(rf"(?is)<form\b{relations.TAG_REST}>"), F.lit(0))
    return F.exists(openers, lambda o: F.coalesce(F.lower(dom.attr(o, "action")).contains("contact"), F.lit(False)))


@operator("contacts")
def contacts(pages: DataFrame) -> DataFrame:
    """E-mails, phones, address and contact form of every page."""
    body = text.markup(F.col("html"))
    read = with_outline(pages).select(
        *PAGE,
        text.strip_tags(body).alias("shown"),
        has_contact_form(body).alias("form"),
        address().alias("address"),
    )
    return read.select(
        *PAGE,
        text.extract_emails(F.col("shown")).alias("emails"),
        text.extract_phones(F.col("shown")).alias("phones"),
        "address",
        F.when(F.col("form"), relations.base_url(F.col("url"))).alias("contact_form_url"),
    )


@operator("brand_record")
def brand_record(pages: DataFrame) -> DataFrame:
    """Name, description, logo, currencies and payment methods of every page."""
    html, body = F.col("html"), text.markup(F.col("html"))
    read = with_outline(pages).select(
        *PAGE,
        relations.title_text(html).alias("title"),
        relations.meta_content(html, "property", "og:site_name").alias("site_name"),
        relations.meta_content(html, "name", "description").alias("description"),
        relations.meta_content(html, "property", "og:description").alias("og_description"),
        logo_alt().alias("logo_alt"),
        logo().alias("logo_src"),
        F.concat(
            F.array_compact(F.array(relations.script_value(html, r"Shopify\.currency"))), currency_codes()
        ).alias("codes"),
        F.lower(text.strip_tags(body)).alias("shown"),
        payment_icons(body).alias("icons"),
    )
    return brand_description(brand_name(read)).select(
        *PAGE,
        "brand_name",
        "brand_description",
        urls.resolve_url(F.col("logo_src"), relations.base_url(F.col("url"))).alias("logo_url"),
        F.array_sort(F.array_distinct("codes")).alias("currencies"),
        payment_names(F.col("shown"), F.col("icons")).alias("payment_methods"),
    )
