"""Page operators on hand-written pages, with rows worked out by hand."""

from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import outline
from storelens.operators import brand, faqs, hero, links, policies, products, relations
from storelens.sources import feeds

SHOP = "https://shop.example.com/"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tags_are_paired_like_a_tree():
    page = "<div a><p>1<b>2</p><ul><li>x<li>y</ul></div><i>z</i></u>"
    nodes = [(n.tag, page[n.inner : n.inner_stop]) for n in outline.pair_tags(page)]
    assert nodes == [
        ("div", "<p>1<b>2</p><ul><li>x<li>y</ul>"), ("p", "1<b>2"), ("b", "2"), ("ul", "<li>x<li>y"),
        ("li", "x"), ("li", "y"), ("i", "z"),
    ]


def test_nested_blocks_keep_their_own_text(pages):
    html = '<div class="product"><div class="product-title"><div>In</div>ner</div><div class="price">$1</div></div><p>out</p>'
    found = relations.elements(pages((SHOP, html)))
    assert rows(found, "cls", "text") == [("price", "$1"), ("product", "In ner $1"), ("product-title", "In ner")]


def test_links_inside_comments_and_scripts_do_not_count(pages):
    html = '<!-- <a href="/no">n</a> --><script>"<a href=\'/no\'>"</script><a name="x">t</a><a href=/yes>Y <b>s</b><A HREF="b?x&amp;y">z</A>'
    found = relations.links(pages((SHOP + "p/q", html)))
    assert rows(found, "seq", "href", "link_url", "text") == [
        (1, "/yes", SHOP + "yes", "Y s"), (2, "b?x&y", SHOP + "p/b?x&y", "z"),
    ]


def test_structured_data_shapes(pages):
    def script(body):
        return f'<script type="application/ld+json">{body}</script>'

    html = (
        script('{"@type":"Product","name":"A","offers":{"price":12.5,"availability":"x/OutOfStock"},"image":"/a.png"}')
        + script("{broken") + script('[{"@type":"Thing","name":"T"},{"@type":"Product","name":"B","offers":[{"price":"7",'
        '"priceCurrency":"EUR"}],"image":["/b.png","/c.png"],"url":"b"},{"@type":"Product","name":""},{"@type":"Product"}]')
        + script('{"@type":"Product","name":"C","offers":[],"image":{"url":"https://cdn/c.png"}}')
        + script('{"@type":"Product","name":"D","offers":{"price":"call"}}') + script('{"@type":"Product","name":"E","offers":{"price":0}}')
    )
    items = relations.structured_items(pages((SHOP, html)))
    found = products.products_from_jsonld(items)
    assert rows(found, "seq", "name", "price_text", "in_stock") == [
        (0, "A", "$12.50", False), (2, "B", "7.00 EUR", True), (5, "C", None, True),
        (6, "D", "call", True), (7, "E", None, True),
    ]
    assert rows(found, "name", F.coalesce("image_url", F.lit("")), F.coalesce("product_url", F.lit("")))[:3] == [
        ("A", SHOP + "a.png", ""), ("B", SHOP + "b.png", SHOP + "b"), ("C", "https://cdn/c.png", ""),
    ]
    legacy = products.products_from_jsonld_legacy(items)
    assert rows(legacy, "name", F.coalesce("price_text", F.lit("")), F.coalesce(F.col("in_stock").cast("string"), F.lit("?")))[:2] == [
        ("A", "12.5", "false"), ("B", "EUR 7", "?"),
    ]


CARDS = """
<div class="wrap"><div class="product-card"><h3 class="product-title">Red Lamp</h3><span class="price">from 10</span>
<strong class="money">€ 19,99</strong><span class="was-price">$29.99</span><img src="/s.png" data-src="/d.png">
<a href="/products/red-lamp">more</a><p>short</p><p class="description">A very fine lamp</p>
<button class="btn add-to-cart" disabled>Add</button><div class="tags"><span class="tag">New!</span></div><span class="tag">no</span></div></div>
<div class="product-tile" data-product-url="/products/tile"><h2>Ab</h2><div class="title">Tile</div>
<div class="stock-status">Sold out</div></div>
<div class="grid"><div class="myproduct"><h4>Plain thing</h4><a href="/about">x</a></div></div>
"""


def test_cards(pages):
    found = products.products_from_cards(pages((SHOP, CARDS)))
    got = rows(found, "branch", "name", F.coalesce("price_text", F.lit("-")), "in_stock", F.coalesce("product_url", F.lit("-")))
    assert (1, "Red Lamp", "19,99", False, SHOP + "products/red-lamp") in got
    assert (1, "Tile", "-", False, SHOP + "products/tile") in got
    assert (2, "Plain thing", "-", True, "-") in got
    lamp = found.filter("name = 'Red Lamp' and branch = 1").first()
    assert (lamp.currency, lamp.original_price_text, lamp.image_url) == ("EUR", "29.99", SHOP + "d.png")
    assert (lamp.description, lamp.tags) == ("A very fine lamp", ["New!"])
    assert products.union_products(pages((SHOP, CARDS))).count() == 3


def test_card_styles(pages):
    page = pages((SHOP, '<div class="product"><h1>Big name</h1><p>' + "word " * 60 + "</p></div>"))
    assert products.products_from_cards(page).count() == 0
    found = products.products_from_cards(page, style="hero").first()
    assert (found.name, len(found.description)) == ("Big name", 150)
    legacy = pages((SHOP, '<div class="product-block"><h2>Two</h2><span class="price">Rs. 30 now</span><p>Out of stock</p></div>'
                          '<div class="product"><h3>Not read</h3></div>'))
    got = products.products_from_cards(legacy, style="legacy").first()
    assert (got.name, got.price_text, got.currency, got.in_stock) == ("Two", "Rs. 30", "INR", False)


def test_single_product_prefers_the_main_block(pages):
    html = '<div class="product-single"><h2>Main one</h2></div>' + CARDS
    assert products.single_product(pages((SHOP, html))).first().name == "Main one"


def test_single_product_reads_blocks_once_and_where_they_decide(pages):
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "Listed"}</script>'
    held = {
        "main": ld + '<div class="x product"><h2>Main one</h2></div><div class="product"><h2>Second</h2></div>',
        "later": ld + '<div class="product"><p>x</p></div><div class="product"><h2>Second</h2></div><div DATA-PRODUCT-SINGLE><h2>Marked</h2></div>',
        "listed": ld + CARDS, "named": ld + "<div class=product-grid><h2>x</h2></div><p>product</p>",
        "card": ld.replace("Listed", "") + '<div class="product-card"><h3>Card one</h3></div>', "id": ld + "<div ID='product'><h2>By id</h2></div>",
    }
    found = products.single_product(pages(*[(f"{SHOP}products/{k}", v) for k, v in held.items()]))
    names = {r.url.rsplit("/", 1)[1]: r.name for r in found.collect()}
    assert names == {"main": "Main one", "later": "Marked", "listed": "Listed", "named": "Listed", "card": "Card one", "id": "By id"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


HERO = """
<div class="banner"><a href="/products/mini-lamp?x=1"><img src="/m.png"></a><a href="/about">no</a></div>
<section class="hero slideshow"><div class="product-item"><h1>Hero Lamp</h1><a href="/products/hero-lamp">Hero Lamp</a></div></section>
<div class="collection-list"><div class="collection-item"><div class="product-x"><h3>In collection</h3></div></div>
<div class="product"><h3>Beside</h3></div></div>
<div class="featured"><div class="featured-product"><h3>Featured one</h3><span class="price">$5</span></div></div>
"""


def test_hero_sections_and_position(pages):
    page = pages((SHOP, HERO))
    got = [r.name for r in products.dedup_products(hero.union_hero(page), order=hero.ORDER).orderBy(*hero.ORDER).collect()]
    assert got == ["Hero Lamp", "Featured one", "Mini Lamp", "In collection"]
    ranked = hero.hero_position(page).orderBy("hero_rank")
    assert [(r.name, r.score) for r in ranked.collect()] == [
        ("Mini Lamp", 118), ("Featured one", 114), ("Hero Lamp", 100), ("In collection", 97),
    ]


def test_hero_position_keeps_the_best_of_many(pages):
    cards = "".join(
        f'<div class="product"><h3>Item {i:03d}</h3>' + ('<img src="/x.png"><span class="price">$1</span>' if i == 30 else "") + "</div>"
        for i in range(200)
    )
    ranked = hero.hero_position(pages((SHOP, f'<div class="hero">{cards}</div>'))).orderBy("hero_rank")
    assert [r.name for r in ranked.collect()] == [
        "Item 030", "Item 000", "Item 001", "Item 002", "Item 003", "Item 004",
    ]


BRAND = """
<title>Acme | Online Shop</title><meta content="Short" name="description"><meta property='og:description' content="Long enough &amp; clear words">
<script>Shopify.currency = 'EUR'</script><div class="brand"><img alt="Acme mark" src="/b.png"></div>
<div class="site-logo"><span><img data-src="/logo.png"></span></div><div class="Currency-list"><a>USD $</a><span>usd</span><p>GBP</p></div>
<img src="/payment/amex.svg" alt="Amex"><p>Cash on delivery, promo code, contact: A@b.co</p>
<form method=post action="/Contact"></form><p class="my-address">1 Main Street, Springfield, 11111</p>
"""


def test_brand_and_contacts(pages):
    got = brand.brand_record(pages((SHOP, BRAND))).first()
    assert (got.brand_name, got.brand_description) == ("Acme", "Long enough  clear words")
    assert (got.logo_url, got.currencies) == (SHOP + "logo.png", ["EUR", "USD"])
    assert got.payment_methods == ["American Express", "Cash on Delivery"]
    who = brand.contacts(pages((SHOP, BRAND))).first()
    assert (who.emails, who.address, who.contact_form_url) == (["A@b.co"], "1 Main Street, Springfield, 11111", SHOP[:-1])


def test_brand_name_falls_back(pages):
    site_name = f'<title>{"x" * 120}</title><meta property="og:site_name" content="Named">'
    logo = '<title> - Shop</title><div class="logo"><img alt="Logo of A"></div><div class="brand"><img alt="Alt name"></div>'
    got = {r.url: r.brand_name for r in brand.brand_record(pages(("https://a.b/", site_name), ("https://c.d/", logo))).collect()}
    assert got == {"https://a.b/": "Named", "https://c.d/": "Alt name"}


LINKS = """
<a href="https://instagram.com/one?utm=1">i</a><a href="https://www.instagram.com/two?utm=2">i</a><a href="https://netflix.com/x">n</a>
<a href="/pages/contact-blog">Both</a><a href="/news">News</a><a href="/x">Blog</a><a href="/size">Size guide</a><a href="/jobs">Jobs</a>
<a href="/legal/privacy">P</a><a href="/a">Return rules</a><a href="/refund">Refund &amp; exchange</a><a href="/terms">Terms</a>
"""


def test_links_by_slot(pages):
    found = relations.links(pages((SHOP, LINKS)))
    assert rows(links.social_links(found), "slot", "link_url") == [("instagram", "https://www.instagram.com/two")]
    assert rows(links.important_links(found), "slot", "link_url") == [
        ("blogs", SHOP + "news"), ("careers", SHOP + "jobs"), ("contact_us", SHOP + "pages/contact-blog"), ("size_guide", SHOP + "size"),
    ]
    assert rows(policies.policy_links_legacy(found), "slot", "policy_url") == [
        ("privacy_policy", SHOP + "legal/privacy"), ("refund_policy", SHOP + "refund"), ("return_policy", SHOP + "a"),
        ("terms_of_service", SHOP + "terms"),
    ]


def test_policies_union_and_slots(pages):
    page = pages((SHOP, LINKS + "<h2>Privacy and terms</h2><p>We keep all your data safe.</p>no tags but long text<p>tiny</p><h3>x</h3><p>not this one at all</p>"))
    found = policies.union_policies(page)
    assert rows(found, "branch", "title", "policy_url") == [
        (0, "Privacy Policy", SHOP + "legal/privacy"), (1, "Privacy Policy", SHOP[:-1]), (2, "Terms", SHOP + "terms"),
        (2, "Terms of Service", SHOP + "legal/privacy"), (3, "Terms of Service", SHOP[:-1]),
        (8, "Refund  exchange", SHOP + "refund"), (8, "Return rules", SHOP + "a"),
    ]
    text = found.filter("branch = 1").first().content
    assert text == "## Privacy and terms\nWe keep all your data safe.\nno tags but long text"
    slots = policies.policy_slots(found)
    assert rows(slots, "slot", "policy.title", "policy.url") == [
        ("privacy_policy", "Privacy Policy", SHOP[:-1]), ("refund_policy", "Refund  exchange", SHOP + "refund"),
        ("return_policy", "Return rules", SHOP + "a"), ("terms_of_service", "Terms of Service", SHOP[:-1]),
    ]


def test_policy_page_detail(pages):
    html = (
        "<title>T</title><h1>Refund policy</h1><div class='rte'>Intro words here<h2>Steps</h2><ol><li>Ask us<li>Send it</ol>"
        "<ul><li>Fast</li></ul><p>We pay the money back within thirty days of delivery, whatever the reason was.</p></div>Updated 2024-05-01"
    )
    got = policies.policy_page_detail(pages((SHOP + "policies/refund", html))).first()
    assert got.content == (
        "Intro words here\n\n## Steps\n\n1. Ask us\n2. Send it\n• Fast\nWe pay the money back within thirty days of delivery, whatever the reason was."
    )
    assert (got.title, got.last_updated, got.policy_type) == ("Refund policy", "2024-05-01", "refund")


FAQ = """
<div class="faq"><h2>FAQ</h2><div><h3>How long is shipping ?</h3><p>About three days.</p><span>skip</span><ul><li>fast</li></ul></div>
<h3>Tiny?</h3><p>no</p><h3>HOW long is shipping?</h3><p>A different answer</p></div>
<section class="help-toggle"><div class="accordion"><button>Can I pay by card?</button><div class="panel"><div class="body-text">Yes, any <div>card</div> works</div></div></div></section>
<div class="questions"><dl><dt>What sizes exist</dt><dt>Second term here</dt><dd>All of the sizes</dd><dd>second answer text</dd><dt>No text left</dt></dl></div>
"""


def test_faq_methods(pages):
    found = faqs.faq_blocks(pages((SHOP, FAQ)))
    assert rows(found, "seq", "question", "answer", "category") == [
        (0, "How long is shipping?", "About three days. fast", "Shipping & Orders"),
        (1, "HOW long is shipping?", "A different answer", "Shipping & Orders"),
        (2, "Can I pay by card?", "Yes, any card works", "General"),
        (3, "What sizes exist", "All of the sizes", "Product Information"),
        (4, "Second term here", "second answer text", "General"),
    ]
    assert rows(faqs.dedup_faqs(found), "seq") == [(0,), (2,), (3,), (4,)]


def test_faq_pages_prefer_feeds_and_fall_back_to_main(spark, pages):
    known = pages(
        ("https://a.com/pages/faq", '<div class="faq"><h3>From the page?</h3><p>page answer text</p></div>'),
        ("https://a.com/faq", "<main><h3>Only in main?</h3><p>main answer text</p></main>"),
        ("https://a.com/other", '<div class="faq"><h3>Unknown path?</h3><p>never read this</p></div>'),
    )
    body = '{"page":{"body_html":"&lt;h3&gt;From the feed?&lt;/h3&gt;<p>feed answer text</p>"}}'
    feed = spark.createDataFrame([("https://a.com/pages/faq.json", body), ("https://a.com/faq.json", "nope")], "url string, body string")
    found = faqs.faq_page_set(relations.with_site(known), feeds.read_faq_feed(feed))
    assert rows(found, "source_rank", "question") == [(1, "From the feed?"), (6, "Only in main?")]


def test_faq_legacy(pages):
    html = (
        '<div class="faq-item"><h4>Is this legacy?</h4><div class="answer">Yes it is</div></div>'
        '<div class="question">First line is it\nsecond line\nthird</div><dl><dt>Defined term</dt><dd>Text</dd></dl>'
    )
    got = rows(faqs.faq_legacy(pages((SHOP, html))), "question", "answer")
    # The first block matches two selectors and nothing is deduplicated.
    assert got == [
        ("Defined term", "Text"), ("First line is it", "second line third"), ("Is this legacy?", "Yes it is"), ("Is this legacy?", "Yes it is"),
    ]


def test_product_feed(spark):
    body = (
        '{"products":[{"title":"A","handle":"a","body_html":"<p>Hi</p>","images":[{"src":"/a.png"}],'
        '"variants":[{"price":"10.00","compare_at_price":"12.00","available":false},{"price":"1"}],"tags":"New, Homepage"},'
        '{"title":"B","variants":[{"price":5,"compare_at_price":"5"}],"tags":["x","Y"]},{"title":""},'
        '{"title":"C","variants":[{"price":"1","compare_at_price":"soon"}]},{"title":"D","extra":1}]}'
    )
    raw = [("https://s.com/products.json?page=2", '{"products":[{"title":"Z","tags":[]}]}'), ("https://s.com/products.json", body),
           ("https://t.com/products.json", "oops")]
    feed = feeds.read_product_feed(spark.createDataFrame(raw, "url string, body string"))
    found = products.products_from_feed(feed).orderBy("seq")
    got = [(r.name, r.price_text, r.original_price_text, r.in_stock, r.product_url, r.tags) for r in found.collect()]
    assert got == [
        ("A", "$10.00", "$12.00", False, "https://s.com/products/a", ["New", "Homepage"]), ("B", "$5", None, True, None, ["x", "Y"]),
        ("D", None, None, True, None, None), ("Z", None, None, True, None, None),
    ]
    top = hero.hero_products(products.products_from_feed(feed, style="hero")).first()
    assert (top.name, top.tags, top.description, top.hero_rank) == ("A", ["new", "homepage"], "pHip", 1)


def test_sitemap_and_product_urls(spark, pages):
    xml = (
        "<sitemapindex><sitemap><loc>https://s.com/products/no</loc></sitemap></sitemapindex><urlset><url><loc>https://s.com/products/a?x=1&amp;y</loc></url>"
        "<url>\n<loc> https://s.com/pages/p </loc></url></urlset>"
    )
    locs = feeds.read_sitemap_urls(spark.createDataFrame([("https://s.com/sitemap.xml", xml)], "url string, body string"))
    assert rows(locs, "loc") == [("https://s.com/products/a?x=1&y",)]
    found = products.product_urls(
        pages(
            ("https://s.com/", '<a href="/products/main">m</a>'), ("https://s.com/collections/all", "nothing"),
            ("https://s.com/collections", '<a href="/products/c1">c</a>'), ("https://s.com/products", '<a href="/products/p1">p</a>'),
            ("https://s.com/other", '<a href="/products/o1">o</a>'),
        ),
        locs,
    )
    assert [u for _, u in rows(found, "site", "product_url")] == [
        "https://s.com/products/a?x=1&y", "https://s.com/products/c1", "https://s.com/products/main",
    ]


def test_search_links_cut_before_filters(spark):
    links_html = "".join(f'<a class="x result__a" href="{"https://s%d.com" % i if i % 2 else "/r%d" % i}">l</a>' for i in range(20))
    any_html = '<a href="https://www.bing.com/x">b</a>' * 3 + '<a href="https://t.com">t</a>'
    saved = spark.createDataFrame(
        [("b.com", 0, 0, "duckduckgo", "https://d.com/?q", links_html), ("b.com", 0, 0, "bing", "https://b.com/?q", any_html)],
        "site string, strategy int, query_rank int, engine string, url string, html string",
    )
    got = rows(feeds.read_search_links(saved), "engine_rank", "url")
    assert got == sorted([(0, f"https://s{i}.com") for i in range(1, 15, 2)] + [(1, "https://t.com")])


def test_search_links_of_each_saved_copy(spark):
    """Two saved copies of one result page are cut one by one, whatever stands in their tags."""
    schema = "site string, strategy int, query_rank int, engine string, url string, html string"
    page = "".join(f'<a href="https://s{i}.com?a=1&amp;b=2">l</a>' for i in range(25))
    odd = (
        '<a title="<a href=https://in.com>x</a>" href=https://z.com>z</a><a <b title=\'<i>\' href="https://t.com">t</a><a href="https://open.com>o'
        '<a href=\'https://q.com\' title="a > b">q</a><a name="n">n</a><A\nHREF=https://u.com>u</A><a href="https://last.com"'
    )
    saved = spark.createDataFrame([("b.com", 0, 0, "bing", "https://r.com/?q", html) for html in (page, page, odd)], schema)
    got = rows(feeds.read_search_links(saved.limit(2)), "url", "seq")
    assert got == sorted([(f"https://s{i}.com?a=1&b=2", i + 1) for i in range(20)] * 2)
    plan = feeds.read_search_links(saved)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan  # only links that stay leave the page's row
    there = relations.links(saved.filter(~F.col("html").startswith(page)).select("url", "html"))
    assert rows(feeds.read_search_links(saved.filter(~F.col("html").startswith(page))), "url") == rows(there, "href") != []


def test_platform_flags(spark, pages):
    page = pages(("https://a.com/", "<script src='//CDN.shopify.com/x'>"), ("https://a.myshopify.com/", "x"), ("https://b.com/", "shop_id"))
    assert rows(relations.detect_platform(page), "site", "on_platform") == [("a.com", True), ("a.myshopify.com", True), ("b.com", False)]
    with_headers = page.withColumn("headers", F.create_map(F.lit("X-ShopId"), F.lit("1")))
    assert rows(relations.detect_platform_loose(page), "on_platform") == [(False,), (True,), (True,)]
    assert rows(relations.detect_platform_loose(with_headers), "on_platform") == [(True,)] * 3


def test_rule_tables_can_be_extended(pages):
    extra = (("wishlist", ("wish",)), *rules.IMPORTANT_LINK_RULES)
    found = relations.links(pages((SHOP, '<a href="/wish/track">w</a>')))
    assert rows(links.important_links(found, extra), "slot") == [("wishlist",)]


def test_policy_pages_are_read_once(pages):
    long = "<main><h2>Terms</h2><p>" + "word " * 30 + "</p></main>"
    given = pages(*[(f"{SHOP}policies/{k}", f"<title>{t}</title><nav>menu</nav>{b}") for k, t, b in (("a", "Refund rules", long), ("b", "Shipping", "<p>Soon</p>"), ("c", "", long), ("d", "Privacy", "<nav>x</nav>"))])
    found = policies.policy_page_detail(given)
    rows = {r.url.rsplit("/", 1)[1]: r.content for r in found.collect()}
    assert rows.keys() == {"a", "b", "d"} and rows["a"].startswith("\n## Terms") and rows["b"] == "Shipping Soon" and rows["d"] == "Privacy"
    # Tags are taken out of a page's markup where its regions are dropped; a filter on the columns would have it twice.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("header|footer") == 1
