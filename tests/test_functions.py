"""Scalar rules on small values."""

import pytest
from pyspark.sql import functions as F

from storelens.functions import dom, text, urls
from storelens.operators.links import social_slot


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, expected",
    [("  Écran \n  large™ & more! ", "Écran large  more!"), ("a\tb (c) - d?", "a b (c) - d?"), ("", "")],
)
def test_clean_text(spark, given, expected):
    assert value(spark, text.clean_text(F.lit(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("How  long ? ", "How long?"), ("Sizes :", "Sizes:"), ("a​b c", "a b c"), ("Why? Because", "Why? Because")],
)
def test_clean_faq_text(spark, given, expected):
    assert value(spark, text.clean_faq_text(F.lit(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("A &amp; B &lt;x&gt;", "A & B <x>"),
        ("&eacute;&#233;&#xE9;&#x1F600;", "ééé😀"),
        ("&unknown; &amp;lt; AT&T; &", "&unknown; &lt; AT&T; &"),
        ("&#xD800; &#1114112;", "&#xD800; &#1114112;"),
        ("it&apos;s &quot;ok&quot;&nbsp;", "it's \"ok\" "),
        ("plain", "plain"),
    ],
)
def test_unescape_html(spark, given, expected):
    assert value(spark, text.unescape_html(F.lit(given))) == expected


def test_visible_text_skips_hidden_parts_and_regions(spark):
    html = "<nav>menu</nav><!-- <p>no</p> --><p>one<b>two</b></p><script>var a='<p>x</p>'</script><STYLE>p{}</STYLE>three"
    assert value(spark, text.visible_text(F.lit(html))) == "menu one two three"
    assert value(spark, text.visible_text(F.lit(html), drop_regions=True)) == "one two three"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Now $1,299.50 only", "$1,299.50"),
        ("12 € today", "12 €"),
        ("rs. 300", "rs. 300"),
        ("USD 45", "USD 45"),
        ("free", None),
        ("$5 or 6€", "$5"),
    ],
)
def test_extract_price(spark, given, expected):
    assert value(spark, text.extract_price(F.lit(given))) == expected


def test_price_amount_and_format(spark):
    assert float(value(spark, text.price_amount(F.lit("$1,299.50")))) == 1299.5
    assert value(spark, text.format_price(F.lit("12.5"), F.lit("USD"))) == "$12.50"
    assert value(spark, text.format_price(F.lit("12.5"), F.lit("EUR"))) == "12.50 EUR"
    assert value(spark, text.format_price(F.lit("on request"), F.lit("EUR"))) == "on request"
    assert value(spark, text.format_price(F.lit(""), F.lit("EUR"))) is None


def test_emails_and_phones(spark):
    given = F.lit("b@x.org a@x.org, a@x.org é1@y.com; +1-555-123-4567 (555) 123-4567 555.123.4567 +123456789012")
    assert value(spark, text.extract_emails(given)) == ["a@x.org", "b@x.org"]
    phones = value(spark, text.extract_phones(given))
    assert {"(555) 123-4567", "+1-555-123-4567", "555.123.4567"} <= set(phones) and phones == sorted(set(phones))


@pytest.mark.parametrize(
    "href, base, expected",
    [
        ("https://a.com/x", "https://b.com", "https://a.com/x"),
        ("//cdn.com/i.png", "https://b.com/p", "https://cdn.com/i.png"),
        ("/a/b", "https://b.com/p/q", "https://b.com/a/b"),
        ("c", "https://b.com", "https://b.com/c"),
        ("c", "https://b.com/p/q?x=/1", "https://b.com/p/c"),
        ("?q=1", "https://b.com/p#f", "https://b.com/p?q=1"),
        ("#f", "https://b.com/p", "https://b.com/p#f"),
        ("../c/./d", "https://b.com/p/q/r", "https://b.com/p/c/d"),
        ("../../../c", "https://b.com/p/q", "https://b.com/c"),
        ("..", "https://b.com/p/q/r", "https://b.com/p/"),
        ("mailto:a@b.c", "https://b.com", "mailto:a@b.c"),
        ("", "https://b.com/p", "https://b.com/p"),
    ],
)
def test_resolve_url(spark, href, base, expected):
    assert value(spark, urls.resolve_url(F.lit(href), F.lit(base))) == expected


def test_site_and_normal_url(spark):
    assert value(spark, urls.site_of(F.lit("Shop.Example.com/a/"))) == "shop.example.com"
    assert value(spark, urls.normalize_site_url(F.lit("shop.com//"))) == "https://shop.com"
    assert value(spark, urls.host_of(F.lit("https://u:p@Shop.com:8080/x"))) == "shop.com"
    assert value(spark, urls.valid_url(F.lit("shop.com"))) is False
    assert [value(spark, urls.page_rank(F.lit(u))) for u in ("https://a.b/", "https://a.b/x/?y", "https://a.b/x/y")] == [0, 1, 2]
    assert value(spark, urls.name_from_url(F.lit("https://www.my-cool_shop.co.uk/x"))) == "My Cool Shop"


def test_valid_candidate(spark):
    def valid(url):
        return value(spark, urls.valid_candidate(F.lit(url), F.lit("https://own.com")))

    assert [valid(u) for u in ("https://other.com", "https://own.com/x", "https://m.facebook.com", "ftp://other.com", "x")] == [
        True, False, False, False, False,
    ]


def test_social_slot_by_host_or_substring(spark):
    links = ["https://www.Instagram.com/a", "https://netflix.com/a", "//x.com/a", "https://fedex.com"]
    assert [value(spark, social_slot(F.lit(u))) for u in links] == ["instagram", None, "twitter", None]
    assert [value(spark, social_slot(F.lit(u), strict=False)) for u in links] == ["instagram", "twitter", "twitter", "twitter"]


def test_ordered_classes(spark):
    assert value(spark, text.faq_category(F.lit("Can I return my order?"))) == "Shipping & Orders"
    assert value(spark, text.faq_category(F.lit("Hello"))) == "General"
    assert value(spark, text.brand_category(F.lit("a watch string"))) == "jewelry"
    assert value(spark, text.brand_category(F.lit("string"), word_boundary=True)) == "ecommerce"
    assert value(spark, text.policy_type(F.lit("/gdpr"), F.lit("Terms"))) == "privacy"
    assert value(spark, text.policy_type_from_content(F.lit("A"), F.lit(""))) == "legal"
    heads = ["Shipping info", "FAQs", "General information", "Additional notes", "Loyalty program FAQ", "How long?"]
    assert [value(spark, text.is_faq_category_header(F.lit(h))) for h in heads] == [True] * 5 + [False]


@pytest.mark.parametrize(
    "given, expected",
    [("Last updated: 01/02/2024.", "01/02/2024."), ("Effective 2024-05-01", "2024-05-01"), ("never", None)],
)
def test_last_updated(spark, given, expected):
    assert value(spark, text.last_updated(F.lit(given))) == expected


def test_attributes(spark):
    tag = F.lit("<a data-href='no' HREF = \"/x?a=1&amp;b=2\" title='' class=big disabled>")
    assert value(spark, dom.attr(tag, "href")) == "/x?a=1&b=2"
    assert value(spark, dom.attr(tag, "title")) is None
    assert value(spark, dom.attr(tag, "class")) == "big"
    assert value(spark, dom.has_attr(tag, "disabled")) is True
    assert value(spark, dom.has_attr(tag, "enabled")) is False
