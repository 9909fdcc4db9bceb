"""Inputs rendered by Spark from the given tables, and the SQL names for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.text import let


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The narrow rows that pages are rendered from, dealt by key.

    A page costs far more to render and read than its row: a table of one file would leave that to one task at any size.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # A filter on rendered pages would be moved ahead of the deal, and with it their rendering; not past a column that is not deterministic.
    return df.repartition(tasks, key).withColumn("_dealt", F.monotonically_increasing_id()).filter("_dealt >= 0").drop("_dealt")


def pages(spark, sf) -> DataFrame:
    return (table(spark, sf, "pages").select("url", "html"))


def escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render(template: str, **values):
    """Column that fills ``{name}`` places of a template with columns."""
    pieces = []
    for i, piece in enumerate(template.replace("\n", "").split("{{")):
        if i:
            name, piece = piece.split("}}", 1)
            pieces.append(values[name].cast("string") if name in values else F.col(name).cast("string"))
        pieces.append(F.lit(piece))
    return F.concat(*pieces)


# ------------------------------------------------------------- SQL twins of the scalar rules


def sql_strip(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'),"
        f" '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s.,!?()-]', '', 'g'))"
    )


def sql_clean_faq(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({sql_squeeze(x)}, '\\s*\\?\\s*$', '?'), '\\s*:\\s*$', ':'))"
    )


def sql_body(x: str) -> str:
    return (
        f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
    )


def sql_class(rules, default: str, *texts: str) -> str:
    """CASE chain of ordered word rules."""
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, '{w}')" for t in texts for w in words) + f" THEN '{label}'"
        for label, words in rules
    )
    return f"CASE {whens} ELSE {default} END"


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
ORIGIN = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')"
PATH = "regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
RANK = f"length({PATH}) - length(replace({PATH}, '/', ''))"

LINKS_SQL = f"""
anchors AS (
  SELECT {HOST} AS site, url, {RANK} AS page_rank, {ORIGIN} AS origin,
         regexp_extract_all({sql_body('html')}, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
         regexp_extract_all({sql_body('html')}, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t
  FROM pages),
link_rows AS (
  SELECT site, url, page_rank, origin, unnest(range(len(h))) AS seq, unnest(h) AS href, unnest(t) AS raw FROM anchors),
links AS (
  SELECT site, url, page_rank, seq, href, origin || href AS link_url, {sql_strip('raw')} AS text FROM link_rows)
"""

# ------------------------------------------------------------- stores of suppliers: one home page each

HOME = """
<html><head><title>{{s_name}} - Official Store</title>{{meta}}
<meta property="og:site_name" content="{{s_name}}"><meta property="og:description" content="Goods made with care in {{n_name}}">
<script>Shopify.shop = "shop-{{s_suppkey}}.myshopify.com"; Shopify.currency = "{{currency}}";</script></head><body>
<header class="header"><a class="logo" href="/"><img src="/logo-{{s_suppkey}}.png" alt="{{s_name}} mark"></a></header>
<nav><a href="/pages/contact">Contact</a><a href="/blogs/news">News</a><a href="/pages/about-us">About us</a>
<a href="/apps/track-order">Track</a></nav>
<a href="https://www.instagram.com/old{{s_suppkey}}">IG</a><a href="https://www.instagram.com/shop{{s_suppkey}}?utm_source=x">IG</a>
{{twitter}}<a href="https://netflix.com/shop">Film</a>
<select class="currency-picker"><option>GBP £</option><option>CAD</option></select>
<div class="faq-list"><h3>How fast is shipping from {{n_name}} ?</h3><p>It takes about {{s_nationkey}} days from {{n_name}}.</p>
<h3>FAQ</h3><p>Some words that are not an answer</p>
<h3>Can I return goods to {{s_name}}?</h3><p>Yes, within {{s_suppkey}} days of delivery</p></div>
<div class="address">{{s_suppkey}} Long Street, {{n_name}}, Region {{s_nationkey}}</div>
<form action="/contact#f" method="post"></form>
<p>Write to help{{s_suppkey}}@shop{{s_suppkey}}.example.com or call (555) 123-{{phone}}. We take Visa and PayPal.</p>
<img src="/icons/klarna-payment.png" alt="Klarna">
<h2>Privacy in {{n_name}}</h2><p>We keep the data of {{s_name}} safe.</p><p>short</p>
<footer class="footer"><a href="/policies/privacy-policy">Privacy policy</a><a href="/policies/refund-policy">Refunds</a>
<a href="/policies/terms-of-service">Terms of service</a><a href="/policies/shipping-policy">Shipping</a></footer></body></html>
"""


def supplier_homes(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = dealt(table(spark, sf, "supplier"), "s_suppkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    meta = F.when(
        F.col("s_acctbal") >= 5000,
        render('<meta name="description" content="{{n_name}} fashion &amp; goods by {{s_name}}">'),
    ).otherwise(F.lit(""))
    twitter = F.when(
        F.col("s_nationkey") > 12, render('<a href="https://twitter.com/shop{{s_suppkey}}">T</a>')
    ).otherwise(F.lit(""))
    html = render(
        HOME,
        meta=meta,
        twitter=twitter,
        currency=F.when(F.col("s_nationkey") > 12, "EUR").otherwise("USD"),
        phone=F.lpad(F.pmod("s_suppkey", F.lit(10000)).cast("string"), 4, "0"),
    )
    return (rows).select(render("https://shop-{{s_suppkey}}.example.com/").alias("url"), html.alias("html"))


HOMES_SQL = """
homes AS (
  SELECT s.*, n_name, 'shop-' || s_suppkey || '.example.com' AS site,
         'https://shop-' || s_suppkey || '.example.com/' AS url, 'https://shop-' || s_suppkey || '.example.com' AS base
  FROM supplier s JOIN nation ON s_nationkey = n_nationkey)
"""

# ------------------------------------------------------------- product pages: one per part

LD = """{"@context":"https://schema.org","@type":"Product","name":"{{p_name}} {{p_partkey}}",
"url":"/products/{{handle}}","image":{{image}},"description":"{{p_type}} {{p_name}} & more",
"offers":{{open}}{"price":"{{offer}}","priceCurrency":"{{cur}}","availability":"https://schema.org/{{stock}}"}{{close}}}"""

PRODUCT_PAGE = """
<html><head><title>{{p_name}} {{p_partkey}} | Shop {{p_brand}}</title>
<script type="application/ld+json">{{ld}}</script><script type="application/ld+json">{broken</script></head><body>
<div class="product-grid"><div class="product-item" data-product-id="{{p_partkey}}">
<h3 class="product-title">{{p_name}} box {{p_partkey}}</h3><span class="price">${{price}}</span>
<span class="was-price">€{{old_price}}</span><img data-src="/img/{{p_partkey}}.png" src="/blank.png" alt="">
<a href="/products/{{handle}}-box">View</a><p class="product-description">A {{p_type}} {{p_name}} of size {{p_size}}, boxed</p>
<span class="availability">{{avail}}</span><div class="tags"><span class="tag">{{p_type}}</span><span class="tag">size {{p_size}}</span></div>
</div></div></body></html>
"""


def parts(spark, sf) -> DataFrame:
    return (
        dealt(table(spark, sf, "part"), "p_partkey")
        .withColumn("slug", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
        .withColumn("site", render("{{slug}}.example.com"))
        .withColumn("handle", render("{{name}}-{{p_partkey}}", name=F.replace("p_name", F.lit(" "), F.lit("-"))))
        .withColumn("price", F.format_string("%.2f", "p_retailprice"))
        .withColumn("old_price", F.format_string("%.2f", F.col("p_retailprice") + 10))
    )


def product_pages(spark, sf) -> DataFrame:
    odd = F.pmod("p_size", F.lit(2)) == 1
    ld = render(
        LD,
        image=F.when(F.col("p_type") == "STANDARD", render('["/img/{{p_partkey}}.png"]'))
        .when(F.col("p_type") == "LARGE", render('{"url":"/img/{{p_partkey}}.png"}'))
        .otherwise(render('"https://cdn.example.com/{{p_partkey}}.png"')),
        open=F.when(odd, "[").otherwise(""),
        close=F.when(odd, "]").otherwise(""),
        offer=F.when(F.col("p_size") == 50, "ask us").otherwise(F.col("price")),
        cur=F.when(F.col("p_type") == "PROMO", "EUR").otherwise("USD"),
        stock=F.when(F.col("p_type") == "ECONOMY", "OutOfStock").otherwise("InStock"),
    )
    html = render(PRODUCT_PAGE, ld=ld, avail=F.when(F.col("p_size") > 40, "Sold out").otherwise("In stock now"))
    return parts(spark, sf).select(render("https://{{site}}/products/{{handle}}").alias("url"), html.alias("html"))


PARTS_SQL = """
parts AS (
  SELECT *, lower(replace(p_brand, '#', '-')) || '.example.com' AS site,
         lower(replace(p_brand, '#', '-')) || '-b' || (p_partkey // 1250) || '.example.com' AS shop,
         replace(p_name, ' ', '-') || '-' || p_partkey AS handle, printf('%.2f', p_retailprice) AS price,
         printf('%.2f', p_retailprice + 10) AS old_price
  FROM part),
part_pages AS (SELECT *, 'https://' || site AS base, 'https://' || site || '/products/' || handle AS url FROM parts)
"""

# ------------------------------------------------------------- shops of a brand: 1250 part keys each, so bounded


def shops(spark, sf) -> DataFrame:
    bucket = F.floor(F.col("p_partkey") / 1250)
    return parts(spark, sf).withColumn("shop", render("{{slug}}-b{{bucket}}.example.com", bucket=bucket))


FEED_PRODUCT = (
    '{"title":"{{p_name}}","handle":"{{handle}}","body_html":"<p>{{p_type}} {{p_name}}</p>","images":{{images}},'
    '"variants":[{"price":"{{price}}","compare_at_price":{{compare}},"available":{{available}}}],"tags":{{tags}}}'
)


def shop_feeds(spark, sf) -> DataFrame:
    """Feed pages of the shops: page 1 holds sizes up to 25, page 2 the rest."""
    product = render(
        FEED_PRODUCT,
        images=F.when(F.col("p_type") == "SMALL", "[]").otherwise(render('[{"src":"/img/{{p_partkey}}.png"}]')),
        compare=F.when(F.col("p_size") > 30, render('"{{old_price}}"')).otherwise("null"),
        available=F.when(F.col("p_size") > 45, "false").otherwise("true"),
        tags=F.when(F.col("p_type") == "PROMO", '"Homepage, sale"')
        .when(F.col("p_type") == "STANDARD", '["Featured","bestseller","x"]')
        .when(F.col("p_type") == "LARGE", '["hero"]')
        .otherwise("[]"),
    )
    rows = shops(spark, sf).select(
        "shop", (F.when(F.col("p_size") > 25, 2).otherwise(1)).alias("page"), F.struct("p_partkey", product.alias("j")).alias("p")
    )
    grouped = rows.groupBy("shop", "page").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select(
        render("https://{{shop}}/products.json?page={{page}}").alias("url"),
        F.concat(F.lit('{"products":['), F.array_join("ps.j", ","), F.lit("]}")).alias("body"),
    )


FEED_SQL = """
feed AS (
  SELECT *, 'https://' || shop AS base, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS page,
         row_number() OVER (PARTITION BY shop, p_size > 25 ORDER BY p_partkey) - 1 AS pos,
         CASE p_type WHEN 'PROMO' THEN 'Homepage|sale' WHEN 'STANDARD' THEN 'Featured|bestseller|x' WHEN 'LARGE' THEN 'hero' END AS tags
  FROM parts),
feed_rows AS (SELECT *, page * 1000000 + pos AS seq FROM feed)
"""

CARD = (
    '<div class="product-card"><h3 class="product-title">{{p_name}}</h3><span class="price">${{price}}</span>'
    '<a href="/products/{{handle}}">View {{handle}}</a>{{img}}</div>'
)
BANNER_LINK = '<a href="/products/{{handle}}" title="{{p_name}} {{p_partkey}}"></a>'
SECTIONS = (
    ("hero", "SMALL", CARD), ("featured-products", "LARGE", CARD), ("promo-banner", "PROMO", BANNER_LINK),
    ("carousel", "MEDIUM", CARD),
)


def shop_homes(spark, sf) -> DataFrame:
    """Home pages of the shops: a section per part type with the parts in key order."""
    img = F.when(F.pmod("p_partkey", F.lit(2)) == 0, render('<img src="/img/{{p_partkey}}.png">')).otherwise(F.lit(""))
    item = F.when(F.col("p_type") == "PROMO", render(BANNER_LINK)).otherwise(render(CARD, img=img))
    rows = shops(spark, sf).select("shop", "p_type", F.struct("p_partkey", item.alias("h")).alias("i"))

    def section(cls, kind):
        items = F.array_sort(F.collect_list(F.when(F.col("p_type") == kind, F.col("i"))))
        return F.concat(F.lit(f'<div class="{cls}">'), F.array_join(items["h"], ""), F.lit("</div>")).alias(kind)

    grouped = rows.groupBy("shop").agg(*[section(cls, kind) for cls, kind, _ in SECTIONS])
    body = F.concat(F.lit("<html><body>"), *[F.col(kind) for _, kind, _ in SECTIONS], F.lit("</body></html>"))
    return grouped.select(render("https://{{shop}}/").alias("url"), body.alias("html"))


# Products standing in the sections, with the order in which the sections are walked.
SHOP_HERO_SQL = """
placed AS (
  SELECT shop AS site, p_partkey, p_name, price, handle,
         CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS kind,
         'https://' || shop || '/products/' || handle AS product_url,
         CASE WHEN p_partkey % 2 = 0 AND p_type <> 'PROMO' THEN 'https://' || shop || '/img/' || p_partkey || '.png' END AS image_url
  FROM parts WHERE p_type IN ('SMALL', 'LARGE', 'PROMO', 'MEDIUM')),
hero_rows AS (
  SELECT site, kind, 0 AS by_link, p_partkey, p_name AS name, price AS price_text, image_url, product_url FROM placed WHERE kind <> 2
  UNION ALL
  SELECT site, kind, 1, p_partkey, p_name || ' ' || p_partkey, NULL, NULL, product_url FROM placed WHERE kind = 2
  UNION ALL
  SELECT site, kind, 1, p_partkey, 'View ' || handle, NULL, NULL, product_url FROM placed WHERE kind = 0)
"""

# ------------------------------------------------------------- texts as pages


def document_pages(spark, sf) -> DataFrame:
    """One policy page per document."""
    html = render(
        "<html><head><title>Document {{doc_id}}</title></head><body><nav>menu</nav>"
        '<div class="policy-content"><h2>Terms</h2><p>{{t}}</p></div><p>Last updated: 01/02/2024</p></body></html>',
        t=escaped(F.col("text")),
    )
    docs = (table(spark, sf, "documents").select("doc_id", "source", "text"))
    return docs.select(render("https://{{source}}.example.com/policies/{{doc_id}}").alias("url"), html.alias("html"))


def turn_pairs(spark, sf) -> DataFrame:
    """User turn with the assistant turn after it; keyed by (conversation, turn), so no conversation is one group."""
    turns = table(spark, sf, "conversations")
    ask = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return (ask.join(reply, ["conv_id", "turn"]))


PAIRS_SQL = f"""
pairs AS (
  SELECT q.conv_id, q.turn, {sql_clean_faq('q.text')} AS question, {sql_clean_faq('a.text')} AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')
"""


def faq_feeds(spark, sf) -> DataFrame:
    """Page feeds with one question each."""
    body = F.to_json(F.struct(F.struct(render("<h3>{{question}}</h3><p>{{answer}}</p>").alias("body_html")).alias("page")))
    return turn_pairs(spark, sf).select(
        render("https://conv-{{conv_id}}-{{turn}}.example.com/pages/faq.json").alias("url"), body.alias("body")
    )


def faq_lists(spark, sf) -> DataFrame:
    """FAQ pages with a definition list: the question with its answer, then both the other way round."""
    html = render(
        '<html><body><div class="box-help"><dl><dt>{{question}}</dt><dd>{{answer}}</dd>'
        "<dt>{{answer}}</dt><dd>{{question}}</dd></dl></div></body></html>"
    )
    return turn_pairs(spark, sf).select(
        render("https://conv-{{conv_id}}.example.com/pages/help?t={{turn}}").alias("url"), html.alias("html")
    )


def faq_pages(spark, sf) -> DataFrame:
    """FAQ pages with one question each: list, accordion or heading form by turn."""
    html = (
        F.when(
            F.col("turn") == 0,
            render('<div class="faq"><dl><dt>{{question}}</dt><dd>{{answer}}</dd></dl></div>'),
        )
        .when(
            F.col("turn") == 2,
            render(
                '<div id="help-me"><div class="accordion-item"><button>{{question}}</button>'
                '<div class="panel"><div class="answer">{{answer}}</div></div></div></div>'
            ),
        )
        .otherwise(render('<div class="faq"><h4>{{question}}</h4><p>{{answer}}</p></div>'))
    )
    return turn_pairs(spark, sf).select(
        render("https://conv-{{conv_id}}.example.com/pages/help?t={{turn}}").alias("url"),
        F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"),
    )


# ------------------------------------------------------------- candidates: what customers order from whom


def candidates(spark, sf) -> DataFrame:
    """Candidate stores of a customer's brand: the suppliers of its order lines, in order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = (table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        render("c{{o_custkey}}.example.com").alias("site"),
        F.col("l_orderkey").alias("query_rank"),
        F.pmod("l_linenumber", F.lit(3)).alias("engine_rank"),
        F.col("l_linenumber").alias("seq"),
        render("https://www.shop-{{l_suppkey}}.example.com/p?l={{l_linenumber}}").alias("url"),
    )


CANDIDATES_SQL = """
cands AS (
  SELECT 'c' || o_custkey || '.example.com' AS site, l_orderkey AS query_rank, l_linenumber % 3 AS engine_rank,
         l_linenumber AS seq, 'https://www.shop-' || l_suppkey || '.example.com/p?l=' || l_linenumber AS url,
         'Shop ' || l_suppkey AS name, 'www.shop-' || l_suppkey || '.example.com' AS host, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


#: Links of one order line on a result page: one without a class, an advert of the engine, and 24 shops.
SHOWN = 24


def search_pages(spark, sf) -> DataFrame:
    """Saved result pages of a customer's brand: each order is a query, its lines are dealt to three engines.

    Every page has more links than any engine's limit.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    engine = F.pmod("l_linenumber", F.lit(3)) + 1
    name = F.element_at(F.array(*map(F.lit, ("duckduckgo", "bing", "startpage"))), engine)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "l_orderkey", name.alias("engine"), F.struct("l_linenumber", "l_suppkey").alias("line")
    )
    # Only keys are shuffled; a page is rendered from them where it is read.
    pages = rows.groupBy("o_custkey", "l_orderkey", "engine").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    cls = F.when(F.col("engine") == "duckduckgo", "result__a").when(F.col("engine") == "bing", "any").otherwise("w-gl__result-title big")
    # What the shops of a line have in common is put together once.
    common = lambda line: F.struct(
        line["l_suppkey"].alias("first"), F.concat(F.lit('<a class="'), cls, F.lit('" href="https://www.shop-')).alias("head"),
        F.concat(F.lit(".example.com/p?l="), line["l_linenumber"].cast("string"), F.lit('">Shop</a>')).alias("tail"),
    )
    shown = lambda c: F.concat(*(x for i in range(SHOWN) for x in (c["head"], (c["first"] + i).cast("string"), c["tail"])))
    shops = lambda line: F.coalesce(let(common(line), shown), F.lit(""))
    chunk = lambda line: F.concat(
        F.lit('<p><a href="/more">More</a><a class="'), cls, F.lit('" href="https://www.bing.com/ad">Ad</a>'), shops(line), F.lit("</p>")
    )
    strategy = F.greatest(F.pmod("l_orderkey", F.lit(5)) - 2, F.lit(0)).cast("int")
    return pages.select(
        render("c{{o_custkey}}.example.com").alias("site"), strategy.alias("strategy"), F.col("l_orderkey").alias("query_rank"), "engine",
        render("https://{{engine}}.example.org/?q={{l_orderkey}}").alias("url"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform("lines", chunk), ""), F.lit("</body></html>")).alias("html"),
    )


def candidate_pages(spark, sf) -> DataFrame:
    """Two saved pages of every supplier's store; the second shows the platform for some."""
    pages = table(spark, sf, "supplier").withColumn("path", F.explode(F.array(F.lit(""), F.lit("cart"))))
    mark = F.when(F.expr("s_acctbal > 4000 AND path = 'cart'"), F.lit("<script src='https://cdn.Shopify.com/s.js'></script>")).otherwise(F.lit("<p>Plain</p>"))
    return pages.select(render("https://www.shop-{{s_suppkey}}.example.com/{{path}}").alias("url"), mark.alias("html"))


def brand_pages(spark, sf) -> DataFrame:
    """Two saved pages of most customers' brands; the home page tells the category."""
    told = F.when(F.col("c_mktsegment") == "FURNITURE", "Fine fashion").when(F.col("c_mktsegment") == "HOUSEHOLD", "gaming gear").otherwise("Words")
    pages = table(spark, sf, "customer").filter("c_custkey % 7 > 0").withColumn("path", F.explode(F.array(F.lit("a/b"), F.lit(""))))
    title = F.when(F.col("path") == "", told).otherwise(F.lit("fitness deals"))
    return pages.select(
        render("https://c{{c_custkey}}.example.com/{{path}}").alias("url"), render("<html><head><title>{{title}}</title></head></html>", title=title).alias("html")
    )


#: The same as verified candidates; query ranks are spread so that strategies follow one another.
SEARCHED_SQL = f"""
lines AS (
  SELECT o_custkey, l_orderkey, l_linenumber, l_suppkey, l_linenumber % 3 AS engine_rank,
         row_number() OVER (PARTITION BY l_orderkey, o_custkey, l_linenumber % 3 ORDER BY l_linenumber, l_suppkey) - 1 AS nth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shown AS (SELECT *, unnest(range({SHOWN})) AS i FROM lines),
placed AS (SELECT *, CASE engine_rank WHEN 1 THEN nth * {SHOWN + 2} + i + 3 ELSE nth * {SHOWN + 1} + i + 2 END AS seq FROM shown),
listed_shops AS (
  SELECT 'c' || o_custkey || '.example.com' AS site, greatest(l_orderkey % 5 - 2, 0) AS strategy, l_orderkey, engine_rank, seq,
         'https://www.shop-' || (l_suppkey + i) || '.example.com/p?l=' || l_linenumber AS url, 'Shop ' || (l_suppkey + i) AS name
  FROM placed JOIN supplier s ON s.s_suppkey = l_suppkey + i AND s_acctbal > 4000
  WHERE seq <= CASE engine_rank WHEN 1 THEN 20 ELSE 15 END),
checked AS (SELECT * FROM listed_shops QUALIFY engine_rank = min(engine_rank) OVER (PARTITION BY site, strategy, l_orderkey)),
per_query AS (SELECT site, strategy, l_orderkey, count(*) AS n FROM checked GROUP BY ALL),
before AS (
  SELECT site, strategy, l_orderkey, coalesce(sum(n) OVER (
    PARTITION BY site, strategy ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found_before FROM per_query),
verified AS (
  SELECT c.*, strategy * 1000000000000 + l_orderkey AS query_rank FROM checked c JOIN before USING (site, strategy, l_orderkey)
  WHERE strategy > 0 OR found_before < 20),
unique_cands AS (
  SELECT * FROM verified QUALIFY row_number() OVER (PARTITION BY site, lower(name) ORDER BY query_rank, engine_rank, seq, url) = 1)
"""

#: Brands with the category that their saved home page tells.
TOLD_SQL = """
brands AS (
  SELECT 'c' || c_custkey || '.example.com' AS site, c_name AS brand_name, CASE WHEN c_custkey % 7 = 0 THEN 'ecommerce'
           WHEN c_mktsegment = 'FURNITURE' THEN 'fashion' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'gaming' ELSE 'ecommerce' END AS category
  FROM customer)
"""


def brands(spark, sf) -> DataFrame:
    """One brand per customer."""
    return table(spark, sf, "customer").select(
        render("c{{c_custkey}}.example.com").alias("site"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "fashion")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "gaming")
        .otherwise("home")
        .alias("category"),
        F.col("c_name").alias("brand_name"),
    )


BRANDS_SQL = """
brands AS (
  SELECT 'c' || c_custkey || '.example.com' AS site, c_name AS brand_name,
         CASE c_mktsegment WHEN 'FURNITURE' THEN 'fashion' WHEN 'HOUSEHOLD' THEN 'gaming' ELSE 'home' END AS category
  FROM customer)
"""
