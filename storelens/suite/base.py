"""Queries on sources, base relations, predicates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import text, urls
from storelens.operators import links as link_ops
from storelens.operators import ranking, relations
from storelens.sources import feeds, pages as page_source
from storelens.suite import inputs, query
from storelens.suite.inputs import (
    HOMES_SQL, HOST, LINKS_SQL, PARTS_SQL, PATH, RANK, render, sql_body, sql_class, sql_clean, sql_strip,
)

SITE = f"{HOST} AS site"


@query("read_pages", f"SELECT {SITE}, url, {RANK} AS page_rank, length(html) AS n_chars FROM pages WHERE html <> ''")
def read_pages(spark, sf):
    held = relations.with_site(page_source.read_pages(spark, f"{sf}/pages.parquet"))
    return held.select("site", "url", "page_rank", F.length("html").alias("n_chars"))


@query("links", f"WITH {LINKS_SQL} SELECT site, url, page_rank, seq, href, link_url, text FROM links")
def links(spark, sf):
    return relations.links(inputs.pages(spark, sf)).drop("title", "cls", "inner")


@query("links_per_site", f"WITH {LINKS_SQL} SELECT site, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM links GROUP BY 1")
def links_per_site(spark, sf):
    found = relations.links(inputs.pages(spark, sf))
    return found.groupBy("site").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query("first_wins", f"WITH {LINKS_SQL} SELECT site, text, arg_min(link_url, (page_rank, url, seq)) AS link_url FROM links GROUP BY ALL")
def first_wins(spark, sf):
    return ranking.first_wins(relations.links(inputs.pages(spark, sf)), ["site", "text"], "link_url", link_ops.ORDER)


@query("last_wins", f"WITH {LINKS_SQL} SELECT site, text, arg_max(link_url, (page_rank, url, seq)) AS link_url FROM links GROUP BY ALL")
def last_wins(spark, sf):
    return ranking.last_wins(relations.links(inputs.pages(spark, sf)), ["site", "text"], "link_url", link_ops.ORDER)


@query("collect_distinct", f"WITH {LINKS_SQL} SELECT DISTINCT site, href FROM links")
def collect_distinct(spark, sf):
    return ranking.collect_distinct(relations.links(inputs.pages(spark, sf)), ["site"], "href")


# Link slots that occur on the pages.
PAGE_SLOTS = (("articles", ("the", "der", "una")), ("short", ("en", "la")), ("other", ("a", "e")))


@query("classify_links", f"""
WITH {LINKS_SQL}, slotted AS (
  SELECT site, url, seq, href, {sql_class(PAGE_SLOTS, 'NULL', 'lower(href)', 'lower(text)')} AS slot FROM links)
SELECT * FROM slotted WHERE slot IS NOT NULL""")
def classify_links(spark, sf):
    found = link_ops.classify_links(relations.links(inputs.pages(spark, sf)), PAGE_SLOTS)
    return found.select("site", "url", "seq", "href", "slot")


@query("headings", f"""
SELECT {SITE}, url, 0 AS seq, 1 AS level, {sql_strip(f"regexp_extract({sql_body('html')}, '(?is)<h1>(.*?)</h1>', 1)")} AS heading,
       {sql_strip(f"regexp_extract({sql_body('html')}, '(?is)</h1>(.*)$', 1)")} AS block FROM pages""")
def headings(spark, sf):
    return relations.headings(inputs.pages(spark, sf)).drop("page_rank")


@query("page_text", f"SELECT {SITE}, url, {sql_strip(sql_body('html'))} AS text FROM pages")
def page_text(spark, sf):
    return relations.page_text(inputs.pages(spark, sf)).drop("page_rank")


@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("clean_faq_text", f"SELECT conv_id, turn, {inputs.sql_clean_faq('text')} AS cleaned FROM conversations")
def clean_faq_text(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.clean_faq_text(F.col("text")).alias("cleaned"))


TITLE = sql_strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")


@query("page_meta", f"""
WITH {HOMES_SQL}
SELECT site, s_name || ' - Official Store' AS title,
       CASE WHEN s_acctbal >= 5000 THEN n_name || ' fashion & goods by ' || s_name END AS description,
       s_name AS site_name, 'Goods made with care in ' || n_name AS og_description FROM homes""")
def page_meta(spark, sf):
    return relations.page_meta(inputs.supplier_homes(spark, sf)).drop("url", "page_rank")


@query("page_titles", f"SELECT {SITE}, url, {TITLE} AS title FROM pages")
def page_titles(spark, sf):
    return relations.page_meta(inputs.pages(spark, sf)).select("site", "url", "title")


@query("lead_text", f"""
WITH {HOMES_SQL}
SELECT site, concat_ws(' ', CASE WHEN s_acctbal >= 5000 THEN n_name || ' fashion & goods by ' || s_name END,
  s_name || ' - Official Store', 'It takes about ' || s_nationkey || ' days from ' || n_name || '.',
  'Some words that are not an answer', 'Yes, within ' || s_suppkey || ' days of delivery') AS lead FROM homes""")
def lead_text(spark, sf):
    return relations.lead_text(inputs.supplier_homes(spark, sf)).select("site", "lead")


@query("script_vars", f"""
WITH {HOMES_SQL}
SELECT site, 'shop-' || s_suppkey || '.myshopify.com' AS shop_domain,
       CASE WHEN s_nationkey > 12 THEN 'EUR' ELSE 'USD' END AS script_currency FROM homes""")
def script_vars(spark, sf):
    return relations.script_vars(inputs.supplier_homes(spark, sf)).drop("url", "page_rank")


@query("images", f"""
WITH {PARTS_SQL}
SELECT site, url, 0 AS seq, '/blank.png' AS src, '/img/' || p_partkey || '.png' AS data_src,
       base || '/img/' || p_partkey || '.png' AS image_url FROM part_pages""")
def images(spark, sf):
    return relations.images(inputs.product_pages(spark, sf)).drop("page_rank", "data_original", "alt")


@query("forms", f"WITH {HOMES_SQL} SELECT site, 0 AS seq, '/contact#f' AS action FROM homes")
def forms(spark, sf):
    return relations.forms(inputs.supplier_homes(spark, sf)).drop("url", "page_rank")


@query("structured_items", f"""
WITH {PARTS_SQL}
SELECT site, url, 'Product' AS item_type, p_name || ' ' || p_partkey AS name, '/products/' || handle AS link FROM part_pages""")
def structured_items(spark, sf):
    items = relations.structured_items(inputs.product_pages(spark, sf))
    return items.select(
        "site", "url", F.expr("try_variant_get(item, '$[\"@type\"]', 'string')").alias("item_type"),
        F.expr("try_variant_get(item, '$.name', 'string')").alias("name"),
        F.expr("try_variant_get(item, '$.url', 'string')").alias("link"),
    )


@query("sections", f"""
WITH {PARTS_SQL}, cells AS (
  SELECT site, url, unnest(['product-item', 'product-title', 'price', 'was-price', 'availability']) AS cls,
         unnest([NULL, p_name || ' box ' || p_partkey, '$' || price, '€' || old_price,
                 CASE WHEN p_size > 40 THEN 'Sold out' ELSE 'In stock now' END]) AS text FROM part_pages)
SELECT * FROM cells WHERE cls <> 'product-item'""")
def sections(spark, sf):
    found = relations.elements(inputs.product_pages(spark, sf))
    return found.filter(F.col("cls").isin("product-title", "price", "was-price", "availability")).select(
        "site", "url", "cls", "text"
    )


@query("detect_platform", f"""
SELECT {SITE}, url, contains(url, 'myshopify.com') OR {' OR '.join(f"contains(lower(html), '{m.lower()}')" for m in rules.PLATFORM_MARKS)}
       AS on_platform, contains(lower(html), 'track(') AS tracks FROM pages""")
def detect_platform(spark, sf):
    held = inputs.pages(spark, sf)
    flags = relations.platform_flag(F.col("html"), F.col("url"))
    tracks = relations.platform_flag(F.col("html"), F.col("url"), ("track(",))
    return relations.with_site(held).select("site", "url", flags.alias("on_platform"), tracks.alias("tracks"))


@query("detect_platform_loose", f"""
WITH {HOMES_SQL}
SELECT site, true AS on_platform FROM homes
UNION ALL SELECT {SITE}, {' OR '.join(f"contains(lower(html), '{m}')" for m in rules.PLATFORM_MARKS_LOOSE)} FROM pages""")
def detect_platform_loose(spark, sf):
    both = inputs.supplier_homes(spark, sf).unionByName(inputs.pages(spark, sf))
    return relations.detect_platform_loose(both).select("site", "on_platform")


NORMAL = "regexp_replace(CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END, '/+$', '')"


@query("normalize_site_url", f"""
WITH bare AS (SELECT regexp_replace(url, '^http://', '') AS url FROM pages) SELECT url, {NORMAL} AS normal_url FROM bare""")
def normalize_site_url(spark, sf):
    bare = inputs.pages(spark, sf).select(F.regexp_replace("url", "^http://", "").alias("url"))
    return bare.select("url", urls.normalize_site_url(F.col("url")).alias("normal_url"))


@query("valid_url", """
WITH bare AS (SELECT regexp_replace(url, '^http://', '') AS url FROM pages)
SELECT url, regexp_matches(url, '^[a-z]+://[^/?#:]+') AS valid FROM bare""")
def valid_url(spark, sf):
    bare = inputs.pages(spark, sf).select(F.regexp_replace("url", "^http://", "").alias("url"))
    return bare.select("url", urls.valid_url(F.col("url")).alias("valid"))


@query("site_of", f"SELECT url, {SITE}, {PATH} AS path FROM pages")
def site_of(spark, sf):
    return inputs.pages(spark, sf).select(
        "url", urls.site_of(F.col("url")).alias("site"), urls.path_of(F.col("url")).alias("path")
    )


@query("name_from_url", f"""
WITH labels1 AS (SELECT url, split_part(replace({HOST}, 'www.', ''), '.', 1) AS label FROM pages),
words AS (SELECT url, string_split(trim(regexp_replace(label, '[^a-zA-Z0-9]+', ' ', 'g')), ' ') AS w FROM labels1),
parts1 AS (SELECT url, unnest(w) AS word, unnest(range(len(w))) AS i FROM words)
SELECT url, string_agg(upper(word[1:1]) || lower(word[2:]), ' ' ORDER BY i) AS name FROM parts1 GROUP BY url""")
def name_from_url(spark, sf):
    return inputs.pages(spark, sf).select("url", urls.name_from_url(F.col("url")).alias("name"))


@query("valid_candidate", f"""
SELECT url, NOT ({HOST} = 'thther.example.org' OR contains({HOST}, 'free') OR contains({HOST}, 'blog.')) AS valid FROM pages""")
def valid_candidate(spark, sf):
    valid = urls.valid_candidate(F.col("url"), F.lit("https://thther.example.org"), ("free", "blog."))
    return inputs.pages(spark, sf).select("url", valid.alias("valid"))


@query("latest_pages", f"""
WITH canon AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)$', '') AS url FROM pages)
SELECT url, max(page_id) AS page_id FROM canon GROUP BY url""")
def latest_pages(spark, sf):
    canon = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(\.html|/)$", "")
    held = inputs.table(spark, sf, "pages").select(
        "page_id", canon.alias("url"), "html", F.timestamp_seconds("page_id").alias("fetched_at")
    )
    return page_source.latest_pages(held).select("url", "page_id")


@query("current_pages", """
WITH snapshots AS (
  SELECT url, html || '<!--' || v || '-->' AS html, page_id, v,
         CASE WHEN v < 3 THEN TIMESTAMP '2024-01-01' + to_days(CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE v END AS INTEGER)) END AS fetched_at
  FROM pages, (VALUES (0), (1), (2), (3)) s(v) WHERE v < 2 + page_id % 3
  UNION ALL SELECT url, html || '<!--1-->', page_id, 1, TIMESTAMP '2024-01-01' + to_days(CAST(1 AS INTEGER)) FROM pages)
SELECT url, md5(html) AS content, fetched_at FROM snapshots
QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, md5(html) DESC) = 1""")
def current_pages(spark, sf):
    """Two to four snapshots of every page, some of one time, some without, and one of them twice."""
    held = inputs.table(spark, sf, "pages").select("url", "html", "page_id", F.explode(F.array(*map(F.lit, range(4)))).alias("v"))
    held = held.filter("v < 2 + page_id % 3").union(held.filter("v = 1"))
    day = F.when(F.col("page_id") % 3 == 0, 1).otherwise(F.col("v"))
    snapshots = held.select(
        "url", F.concat("html", F.lit("<!--"), F.col("v").cast("string"), F.lit("-->")).alias("html"),
        F.when(F.col("v") < 3, F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("v") == 1, F.lit(1)).otherwise(day) * 86400)).alias("fetched_at"),
    )
    return page_source.current_pages(snapshots).select("url", F.md5("html").alias("content"), "fetched_at")


@query("needed_pages", f"""
WITH p AS (SELECT url, html, {HOST} AS site, {RANK} AS page_rank FROM pages),
f AS (SELECT site, min_by(url, (page_rank, url)) AS url FROM p GROUP BY site)
SELECT p.url, p.site, p.page_rank, md5(html) AS content FROM p LEFT JOIN f USING (url)
WHERE f.url IS NOT NULL OR p.page_rank = 0 OR contains(p.url, '/a')""")
def needed_pages(spark, sf):
    found = page_source.needed_pages(inputs.pages(spark, sf), (), ("/a",))
    return found.select("url", "site", "page_rank", F.md5("html").alias("content"))


# One reference of every form, resolved against every page.
@query("resolve_url", """
WITH forms AS (
  SELECT url, page_id, regexp_replace(url, '[?#].*$', '') AS page, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages)
SELECT page_id, origin || '/a/b' AS rooted, 'https://x.example.com/y' AS absolute,
       regexp_extract(origin, '^[a-z]+:') || '//cdn.example.com/z' AS other_host, page || '?q=1' AS query_only,
       regexp_replace(page, '[^/]*$', '') || 'sub/p' AS relative, origin || '/up.html' AS dotted, 'mailto:a@b.c' AS mail
FROM forms""")
def resolve_url(spark, sf):
    held = inputs.table(spark, sf, "pages")
    forms = {
        "rooted": "/a/b", "absolute": "https://x.example.com/y", "other_host": "//cdn.example.com/z",
        "query_only": "?q=1", "relative": "sub/p", "dotted": "../../../up.html", "mail": "mailto:a@b.c",
    }
    return held.select("page_id", *[urls.resolve_url(F.lit(h), F.col("url")).alias(n) for n, h in forms.items()])


@query("clean_social_url", "SELECT page_id, trim(regexp_replace(url, '\\?.*$', '')) AS cleaned FROM pages")
def clean_social_url(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", urls.clean_social_url(F.col("url")).alias("cleaned"))


@query("unescape_html", "SELECT doc_id, text AS decoded, 'é€’' || doc_id AS codes FROM documents")
def unescape_html(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.unescape_html(inputs.escaped(F.col("text"))).alias("decoded"),
        text.unescape_html(render("&eacute;&#8364;&#x2019;{{doc_id}}")).alias("codes"),
    )


@query("safe_attr", f"WITH {LINKS_SQL} SELECT site, url, count(*) AS n, min(nullif(href, '')) AS low FROM links GROUP BY ALL")
def safe_attr(spark, sf):
    from storelens.functions import dom

    tags = F.regexp_extract_all(text.markup(F.col("html")), F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    openers = relations.with_site(inputs.pages(spark, sf)).select("site", "url", F.explode(tags).alias("opener"))
    return openers.select("site", "url", dom.attr(F.col("opener"), "href").alias("href")).groupBy("site", "url").agg(
        F.count("*").alias("n"), F.min("href").alias("low")
    )


@query("safe_text", f"WITH {LINKS_SQL} SELECT site, nullif(text, '') AS text, count(*) AS n FROM links GROUP BY ALL")
def safe_text(spark, sf):
    shown = relations.links(inputs.pages(spark, sf)).select("site", text.blank_to_null(F.col("text")).alias("text"))
    return shown.groupBy("site", "text").agg(F.count("*").alias("n"))


@query("extract_price", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN printf('%.2f', p_retailprice) || ' €'
  WHEN 'LARGE' THEN 'Rs. ' || printf('%.2f', p_retailprice) WHEN 'SMALL' THEN 'usd ' || printf('%.2f', p_retailprice)
  WHEN 'MEDIUM' THEN NULL ELSE '$' || printf('%.2f', p_retailprice) END AS price_text,
  CASE WHEN p_type <> 'MEDIUM' THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE) END AS amount,
  CASE p_type WHEN 'PROMO' THEN 'EUR' WHEN 'LARGE' THEN 'INR' WHEN 'SMALL' THEN 'USD' WHEN 'MEDIUM' THEN NULL ELSE 'USD' END AS currency
FROM part""")
def extract_price(spark, sf):
    kind = F.col("p_type")
    shown = (
        F.when(kind == "PROMO", render("only {{price}} € today"))
        .when(kind == "LARGE", render("costs Rs. {{price}} now"))
        .when(kind == "SMALL", render("is usd {{price}}"))
        .when(kind == "MEDIUM", F.lit("ask for it"))
        .otherwise(render("from ${{price}} up"))
    )
    found = inputs.parts(spark, sf).select("p_partkey", text.extract_price(shown).alias("price_text"))
    return found.select(
        "p_partkey", "price_text", text.price_amount(F.col("price_text")).cast("double").alias("amount"),
        text.price_currency(F.col("price_text")).alias("currency"),
    )


@query("format_price", """
SELECT p_partkey, CASE WHEN p_size = 50 THEN 'ask' WHEN p_type = 'PROMO' THEN printf('%.2f', p_retailprice) || ' EUR'
  ELSE '$' || printf('%.2f', p_retailprice) END AS price_text FROM part""")
def format_price(spark, sf):
    price = F.when(F.col("p_size") == 50, "ask").otherwise(F.col("p_retailprice").cast("string"))
    currency = F.when(F.col("p_type") == "PROMO", "EUR").otherwise("USD")
    return inputs.table(spark, sf, "part").select("p_partkey", text.format_price(price, currency).alias("price_text"))


JOINED = "array_to_string(list_sort(list_distinct({})), '|')"
EMAILS = JOINED.format(f"regexp_extract_all(text, '{rules.EMAIL_PATTERN}')")
PHONES = JOINED.format(
    "list_concat(" * (len(rules.PHONE_PATTERNS) - 1)
    + f"regexp_extract_all(text, '{rules.PHONE_PATTERNS[0]}')"
    + "".join(f", regexp_extract_all(text, '{p}'))" for p in rules.PHONE_PATTERNS[1:])
)


@query("extract_emails", f"SELECT doc_id, {EMAILS} AS emails FROM documents")
def extract_emails(spark, sf):
    found = F.array_join(text.extract_emails(F.col("text")), "|")
    return inputs.table(spark, sf, "documents").select("doc_id", found.alias("emails"))


@query("extract_phones", f"SELECT doc_id, {PHONES} AS phones FROM documents")
def extract_phones(spark, sf):
    found = F.array_join(text.extract_phones(F.col("text")), "|")
    return inputs.table(spark, sf, "documents").select("doc_id", found.alias("phones"))


@query("policy_type", f"""
SELECT doc_id, {sql_class(rules.POLICY_TYPE_RULES, "'legal'", "lower(source || ' ' || text)")} AS by_title,
  {sql_class(rules.POLICY_TYPE_CONTENT_RULES, "'legal'", "lower(source || ' ' || text)")} AS by_content FROM documents""")
def policy_type(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text.policy_type(F.col("source"), F.col("text")).alias("by_title"),
        text.policy_type_from_content(F.col("source"), F.col("text")).alias("by_content"),
    )


@query("text_category", f"""
SELECT doc_id, {sql_class(rules.BRAND_CATEGORY_RULES, "'ecommerce'", "lower(text)")} AS category FROM documents""")
def text_category(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", text.brand_category(F.col("text")).alias("category"))


@query("faq_category", f"""
SELECT conv_id, turn, {sql_class(rules.FAQ_CATEGORY_RULES, "'General'", "lower(text)")} AS category FROM conversations""")
def faq_category(spark, sf):
    return inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.faq_category(F.col("text")).alias("category")
    )


HEADER = "|".join(f"(?:{p})" for p in rules.FAQ_HEADER_PATTERNS)


@query("is_faq_category_header", f"""
WITH shown AS (SELECT page_id, {TITLE} AS title, CASE page_id % 3 WHEN 0 THEN 'Shipping Information' WHEN 1 THEN 'FAQ' ELSE {TITLE} END AS heading FROM pages)
SELECT page_id, heading, regexp_matches(lower(trim(heading)), '{HEADER}') AS is_header FROM shown""")
def is_faq_category_header(spark, sf):
    place = F.pmod("page_id", F.lit(3))
    heading = F.when(place == 0, "Shipping Information").when(place == 1, "FAQ").otherwise(
        relations.title_text(F.col("html"))
    )
    held = inputs.table(spark, sf, "pages").select("page_id", heading.alias("heading"))
    return held.withColumn("is_header", text.is_faq_category_header(F.col("heading")))


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf):
    parsed = inputs.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return parsed.select("event_id", F.expr("try_variant_get(v, '$.k', 'int')").alias("k"))


@query("top_k_values", """
WITH c AS (SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY ALL)
SELECT user_id, event_type, cnt, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, event_type) AS rank
FROM c QUALIFY rank <= 3""")
def top_k_values(spark, sf):
    return ranking.top_k_values(inputs.table(spark, sf, "events"), ["user_id"], "event_type", 3)


@query("read_search_links", f"""
WITH {LINKS_SQL}, shown AS (SELECT url, seq, link_url FROM links),
cut AS (SELECT * FROM shown WHERE seq < 20)
SELECT url AS site, seq + 1 AS place, link_url FROM cut WHERE NOT contains(link_url, 'bing.com')""")
def read_search_links(spark, sf):
    absolute = F.regexp_replace("html", '<a href="/', F.concat(F.lit('<a href="'), urls.origin_of(F.col("url")), F.lit("/")))
    saved = inputs.pages(spark, sf).select(
        F.col("url").alias("site"), F.lit(0).alias("strategy"), F.lit(0).alias("query_rank"),
        F.lit("bing").alias("engine"), "url", absolute.alias("html"),
    )
    found = feeds.read_search_links(saved)
    return found.select("site", F.col("seq").alias("place"), F.col("url").alias("link_url"))


@query("read_sitemap_urls", f"""
WITH {PARTS_SQL} SELECT shop AS site, 'https://' || shop || '/products/' || handle AS loc FROM parts""")
def read_sitemap_urls(spark, sf):
    entry = render(
        "<url><loc> https://{{shop}}/products/{{handle}} </loc></url><url><loc>https://{{shop}}/pages/x</loc></url>"
    )
    rows = inputs.shops(spark, sf).select("shop", entry.alias("entry"))
    maps = rows.groupBy("shop").agg(F.array_join(F.collect_list("entry"), "").alias("entries")).select(
        render("https://{{shop}}/sitemap.xml").alias("url"),
        render('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{{entries}}</urlset>').alias("body"),
    )
    return feeds.read_sitemap_urls(maps).select("site", "loc")
