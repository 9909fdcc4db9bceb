"""Queries on brand facts, contacts, links by slot, policies, FAQs and the assembled record."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens import rules
from storelens.operators import brand, faqs, links, policies, relations
from storelens.plans import assemble
from storelens.sources import feeds
from storelens.suite import base, inputs, query
from storelens.suite.inputs import (
    FEED_SQL, HOMES_SQL, HOST, LINKS_SQL, PAIRS_SQL, PARTS_SQL, RANK, sql_body, sql_class, sql_clean,
    sql_clean_faq, sql_squeeze, sql_strip,
)

SUFFIX = r"(?i)\s*[-–|]\s*(Shop|Store|Online|Official).*$"
SHORT = f"nullif(trim(regexp_replace({base.TITLE}, '{SUFFIX}', '')), '')"
NAME = sql_clean(f"CASE WHEN length({SHORT}) < 100 THEN {SHORT} END")


@query("brand_name", f"SELECT {HOST} AS site, url, {NAME} AS brand_name FROM pages")
def brand_name(spark, sf):
    return brand.brand_name(relations.page_meta(inputs.pages(spark, sf))).select("site", "url", "brand_name")


DESCRIPTION = "CASE WHEN s_acctbal >= 5000 THEN n_name || ' fashion  goods by ' || replace(s_name, '#', '') ELSE 'Goods made with care in ' || n_name END"
BRAND = "replace(s_name, '#', '')"


@query("brand_description", f"WITH {HOMES_SQL} SELECT site, {DESCRIPTION} AS brand_description FROM homes")
def brand_description(spark, sf):
    meta = relations.page_meta(inputs.supplier_homes(spark, sf))
    return brand.brand_description(meta).select("site", "brand_description")


@query("logo_url", f"WITH {HOMES_SQL} SELECT site, base || '/logo-' || s_suppkey || '.png' AS logo_url FROM homes")
def logo_url(spark, sf):
    return brand.logo_url(inputs.supplier_homes(spark, sf)).select("site", "logo_url")


CURRENCIES = "CASE WHEN s_nationkey > 12 THEN 'CAD|EUR|GBP' ELSE 'CAD|GBP|USD' END"


@query("currencies", f"WITH {HOMES_SQL} SELECT site, {CURRENCIES} AS currencies FROM homes")
def currencies(spark, sf):
    found = brand.currencies(inputs.supplier_homes(spark, sf))
    return found.select("site", F.array_join("currencies", "|").alias("currencies"))


def _payments_sql(text):
    hits = ", ".join(f"CASE WHEN contains({text}, '{w}') THEN '{n}' END" for w, n in rules.PAYMENT_RULES)
    return f"array_to_string(list_sort(list_distinct([{hits}])), '|')"


@query("payment_methods", f"""
WITH {HOMES_SQL}, shown AS (
  SELECT {HOST} AS site, url, {_payments_sql('lower(' + sql_strip(sql_body('html')) + ')')} AS payment_methods FROM pages)
SELECT * FROM shown UNION ALL SELECT site, url, 'Klarna|PayPal|Visa' FROM homes""")
def payment_methods(spark, sf):
    both = inputs.pages(spark, sf).unionByName(inputs.supplier_homes(spark, sf))
    found = brand.payment_methods(both)
    return found.select("site", "url", F.array_join("payment_methods", "|").alias("payment_methods"))


@query("contacts", f"""
WITH {HOMES_SQL}, d AS (
  SELECT source || '.example.com' AS site, 'https://' || source || '.example.com/policies/' || doc_id AS url,
         'Document ' || doc_id || ' menu Terms ' || {sql_squeeze('text')} || ' Last updated: 01/02/2024' AS text FROM documents)
SELECT site, url, {base.EMAILS} AS emails, {base.PHONES} AS phones, NULL AS address, NULL AS contact_form_url FROM d
UNION ALL SELECT site, url, 'help' || s_suppkey || '@shop' || s_suppkey || '.example.com',
  '(555) 123-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'),
  s_suppkey || ' Long Street, ' || n_name || ', Region ' || s_nationkey, base FROM homes""")
def contacts(spark, sf):
    both = inputs.document_pages(spark, sf).unionByName(inputs.supplier_homes(spark, sf))
    found = brand.contacts(both)
    return found.select(
        "site", "url", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"),
        "address", "contact_form_url",
    )


@query("brand_record", f"""
WITH {HOMES_SQL}
SELECT site, {BRAND} AS brand_name, {DESCRIPTION} AS brand_description, base || '/logo-' || s_suppkey || '.png' AS logo_url,
       {CURRENCIES} AS currencies, 'Klarna|PayPal|Visa' AS payment_methods FROM homes""")
def brand_record(spark, sf):
    found = brand.brand_record(inputs.supplier_homes(spark, sf))
    return found.select(
        "site", "brand_name", "brand_description", "logo_url", F.array_join("currencies", "|").alias("currencies"),
        F.array_join("payment_methods", "|").alias("payment_methods"),
    )


# ------------------------------------------------------------- links by slot


@query("social_links", f"""
WITH {HOMES_SQL}
SELECT site, 'instagram' AS slot, 'https://www.instagram.com/shop' || s_suppkey AS link_url FROM homes
UNION ALL SELECT site, 'twitter', 'https://twitter.com/shop' || s_suppkey FROM homes WHERE s_nationkey > 12""")
def social_links(spark, sf):
    return links.social_links(relations.links(inputs.supplier_homes(spark, sf)))


@query("social_links_substring", f"""
WITH {HOMES_SQL}
SELECT site, 'instagram' AS slot, 'https://www.instagram.com/shop' || s_suppkey AS link_url FROM homes
UNION ALL SELECT site, 'twitter', 'https://netflix.com/shop' FROM homes""")
def social_links_substring(spark, sf):
    return links.social_links(relations.links(inputs.supplier_homes(spark, sf)), strict=False)


@query("important_links", f"""
WITH {HOMES_SQL}, slots(slot, path) AS (VALUES ('contact_us', '/pages/contact'), ('blogs', '/blogs/news'),
  ('about_us', '/pages/about-us'), ('order_tracking', '/apps/track-order'), ('shipping_info', '/policies/shipping-policy'))
SELECT site, slot, base || path AS link_url FROM homes, slots""")
def important_links(spark, sf):
    return links.important_links(relations.links(inputs.supplier_homes(spark, sf)))


@query("slots_per_category", f"""
WITH {LINKS_SQL}, slotted AS (
  SELECT *, {sql_class(base.PAGE_SLOTS, 'NULL', 'lower(href)', 'lower(text)')} AS slot FROM links),
firsts AS (SELECT site, slot, arg_min(link_url, (page_rank, url, seq)) AS link_url FROM slotted WHERE slot IS NOT NULL GROUP BY ALL)
SELECT slot, count(*) AS n_sites, min(link_url) AS low_url FROM firsts GROUP BY slot""")
def slots_per_category(spark, sf):
    firsts = links.important_links(relations.links(inputs.pages(spark, sf)), base.PAGE_SLOTS)
    return firsts.groupBy("slot").agg(F.count("*").alias("n_sites"), F.min("link_url").alias("low_url"))


# ------------------------------------------------------------- policies

LINKED_SQL = f"""
{HOMES_SQL}, linked(rank, policy_group, title, path) AS (VALUES
  (0, 'privacy', 'Privacy policy', 'privacy-policy'), (1, 'terms', 'Terms of service', 'terms-of-service'),
  (4, 'refund', 'Refunds', 'refund-policy'), (5, 'shipping', 'Shipping', 'shipping-policy')),
link_policies AS (
  SELECT site, 2 * rank AS branch, policy_group, title, '{rules.POLICY_LINK_CONTENT}' AS content, base || '/policies/' || path AS policy_url
  FROM homes, linked),
embedded AS (
  SELECT site, 1 AS branch, 'privacy' AS policy_group, 'Privacy Policy' AS title,
         '## Privacy in ' || n_name || chr(10) || 'We keep the data of ' || s_name || ' safe.' || chr(10)
         || 'Privacy policy Refunds Terms of service Shipping' AS content, base AS policy_url FROM homes)
"""
POLICY = ("site", "branch", "policy_group", "title", "content", "policy_url")


@query("policy_links", f"WITH {LINKED_SQL} SELECT * FROM link_policies")
def policy_links(spark, sf):
    return policies.policy_links(relations.links(inputs.supplier_homes(spark, sf))).select(*POLICY)


@query("policy_links_legacy", f"""
WITH {HOMES_SQL}, slots(slot, title, path) AS (VALUES ('privacy_policy', 'Privacy Policy', 'privacy-policy'),
  ('refund_policy', 'Refund Policy', 'refund-policy'), ('terms_of_service', 'Terms of Service', 'terms-of-service'))
SELECT site, slot, title, 'Policy available at: ' || base || '/policies/' || path AS content, base || '/policies/' || path AS policy_url
FROM homes, slots""")
def policy_links_legacy(spark, sf):
    return policies.policy_links_legacy(relations.links(inputs.supplier_homes(spark, sf)))


@query("policy_embedded", f"WITH {LINKED_SQL} SELECT * FROM embedded")
def policy_embedded(spark, sf):
    return policies.policy_embedded(inputs.supplier_homes(spark, sf)).select(*POLICY)


@query("union_policies", f"WITH {LINKED_SQL} SELECT * FROM link_policies UNION ALL SELECT * FROM embedded")
def union_policies(spark, sf):
    return policies.union_policies(inputs.supplier_homes(spark, sf)).select(*POLICY)


# Links of the given pages as policies, titled by their text, so that sites repeat them.
WORD_RULES = (("articles", "Article", ("the", "der")), ("short", "Short word", ("en", "la")))


def word_policies(spark, sf):
    return policies.policy_links(relations.links(inputs.pages(spark, sf)), WORD_RULES)


WORDS_SQL = f"""
{LINKS_SQL}, hits AS (
  SELECT *, 0 AS branch, 'Article' AS fallback, contains(lower(href), 'the') OR contains(lower(href), 'der') AS by_href,
         contains(lower(text), 'the') OR contains(lower(text), 'der') AS by_text FROM links
  UNION ALL
  SELECT *, 2, 'Short word', contains(lower(href), 'en') OR contains(lower(href), 'la'),
         contains(lower(text), 'en') OR contains(lower(text), 'la') FROM links),
word_policies AS (
  SELECT site, url, page_rank, branch, CASE WHEN by_href THEN seq ELSE seq + 1000000000 END AS seq,
         {sql_clean("CASE WHEN length(text) >= 3 THEN text ELSE fallback END")} AS title, link_url AS policy_url
  FROM hits WHERE by_href OR by_text)
"""


@query("dedup_policies", f"""
WITH {WORDS_SQL}
SELECT site, url, branch, title, policy_url FROM word_policies WHERE title <> ''
QUALIFY row_number() OVER (PARTITION BY site, lower(policy_url), lower(title) ORDER BY branch, page_rank, url, seq) = 1""")
def dedup_policies(spark, sf):
    return policies.dedup_policies(word_policies(spark, sf)).select("site", "url", "branch", "title", "policy_url")


@query("policy_slots", f"""
WITH {HOMES_SQL}, slots(slot, title, path) AS (VALUES ('privacy_policy', 'Privacy Policy', NULL),
  ('refund_policy', 'Refunds', 'refund-policy'), ('terms_of_service', 'Terms of service', 'terms-of-service'))
SELECT site, slot, title, coalesce(base || '/policies/' || path, base) AS policy_url FROM homes, slots""")
def policy_slots(spark, sf):
    slots = policies.policy_slots(policies.union_policies(inputs.supplier_homes(spark, sf)))
    return slots.select("site", "slot", F.col("policy.title").alias("title"), F.col("policy.url").alias("policy_url"))


@query("policy_page_detail", f"""
WITH d AS (
  SELECT 'https://' || source || '.example.com/policies/' || doc_id AS policy_url, 'Document ' || doc_id AS title,
         {sql_squeeze('text')} AS t FROM documents),
c AS (
  SELECT *, chr(10) || '## Terms' || chr(10) || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END AS block FROM d),
f AS (SELECT policy_url, title, CASE WHEN length(block) > 100 THEN block ELSE title || ' Terms ' || t || ' Last updated: 01/02/2024' END AS content FROM c)
SELECT *, '01/02/2024' AS last_updated,
       {sql_class(rules.POLICY_TYPE_CONTENT_RULES, "'legal'", "lower(title || ' ' || content)")} AS policy_type FROM f""")
def policy_page_detail(spark, sf):
    found = policies.policy_page_detail(inputs.document_pages(spark, sf))
    return found.select("policy_url", "title", "content", "last_updated", "policy_type")


# ------------------------------------------------------------- questions and answers

GOOD = f"length(question) >= 5 AND NOT regexp_matches(lower(trim(question)), '{base.HEADER}') AND length(answer) > 10"
CATEGORY = sql_class(rules.FAQ_CATEGORY_RULES, "'General'", "lower(question)")


@query("read_faq_feed", f"""
WITH {PAIRS_SQL}
SELECT 'conv-' || conv_id || '-' || turn || '.example.com' AS site, question, answer, {CATEGORY} AS category FROM pairs WHERE {GOOD}""")
def read_faq_feed(spark, sf):
    return feeds.read_faq_feed(inputs.faq_feeds(spark, sf)).select("site", "question", "answer", "category")


FAQ_PAGE_GOOD = f"(turn IN (0, 2) AND length(question) > 5 AND length(answer) > 10 OR turn NOT IN (0, 2) AND {GOOD})"


@query("faq_blocks", f"""
WITH {PAIRS_SQL}
SELECT 'conv-' || conv_id || '.example.com' AS site, turn, question, answer, {CATEGORY} AS category FROM pairs WHERE {FAQ_PAGE_GOOD}""")
def faq_blocks(spark, sf):
    found = faqs.faq_blocks(inputs.faq_pages(spark, sf))
    return found.select(
        "site", F.regexp_extract("url", r"t=(\d+)", 1).cast("int").alias("turn"), "question", "answer", "category"
    )


@query("dt_dd_zip", f"""
WITH {PAIRS_SQL}, both_ways AS (
  SELECT conv_id, question, answer FROM pairs
  UNION ALL SELECT conv_id, {sql_clean_faq('answer')}, {sql_clean_faq('question')} FROM pairs)
SELECT 'conv-' || conv_id || '.example.com' AS site, question, answer FROM both_ways
WHERE length(question) > 5 AND length(answer) > 10""")
def dt_dd_zip(spark, sf):
    return faqs.faq_blocks(inputs.faq_lists(spark, sf)).select("site", "question", "answer")


@query("faq_pairs", f"""
WITH {PAIRS_SQL}, named AS (SELECT *, {CATEGORY} AS category FROM pairs)
SELECT category, count(*) AS n, count(DISTINCT lower(trim(question))) AS n_questions FROM named GROUP BY 1""")
def faq_pairs(spark, sf):
    from storelens.functions import text

    pairs = inputs.turn_pairs(spark, sf).select(text.clean_faq_text(F.col("question")).alias("question"))
    named = pairs.withColumn("category", text.faq_category(F.col("question")))
    return named.groupBy("category").agg(
        F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("question"))).alias("n_questions")
    )


@query("dedup_faqs", f"""
WITH {PAIRS_SQL}
SELECT left(lower(question), 2) || '.example.com' AS site, conv_id, turn, question FROM pairs
QUALIFY row_number() OVER (PARTITION BY site, lower(question) ORDER BY conv_id, turn) = 1""")
def dedup_faqs(spark, sf):
    """Whole questions of all conversations as one list per two-letter start."""
    from storelens.functions import text

    question = text.clean_faq_text(F.col("question"))
    rows = inputs.turn_pairs(spark, sf).select("conv_id", "turn", question.alias("question")).withColumn(
        "site", F.concat(F.lower(F.substring("question", 1, 2)), F.lit(".example.com"))
    )
    return faqs.dedup_faqs(rows, order=("conv_id", "turn")).select("site", "conv_id", "turn", "question")


@query("faq_page_set", f"""
WITH {PAIRS_SQL}, good AS (SELECT *, {CATEGORY} AS category FROM pairs WHERE {FAQ_PAGE_GOOD})
SELECT 'conv-' || conv_id || '.example.com' AS site, turn, question, answer, category, 3 AS source_rank FROM good""")
def faq_page_set(spark, sf):
    found = faqs.faq_page_set(relations.with_site(inputs.faq_pages(spark, sf)))
    return found.select(
        "site", F.regexp_extract("url", r"t=(\d+)", 1).cast("int").alias("turn"), "question", "answer", "category",
        F.col("source_rank").cast("int").alias("source_rank"),
    )


@query("union_faqs", f"""
WITH {PAIRS_SQL}, good AS (SELECT *, {CATEGORY} AS category FROM pairs WHERE {FAQ_PAGE_GOOD})
SELECT 'conv-' || conv_id || '.example.com' AS site, question, answer, category FROM good
QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(question)) ORDER BY turn) = 1""")
def union_faqs(spark, sf):
    """The first turn's page stands for the main page, the others are the known FAQ page of the site."""
    pages = relations.with_site(inputs.faq_pages(spark, sf))
    main = pages.filter(F.col("url").endswith("?t=0"))
    return faqs.union_faqs(main, pages).select("site", "question", "answer", "category")


@query("faq_legacy", f"""
WITH turns AS (
  SELECT q.conv_id, q.turn, {sql_squeeze('q.text')} AS ask, {sql_squeeze('a.text')} AS reply FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'),
both_ways AS (SELECT conv_id, turn, ask, reply FROM turns UNION ALL SELECT conv_id, turn, reply, ask FROM turns)
SELECT 'conv-' || conv_id || '.example.com' AS site, turn, {sql_clean('ask')} AS question, {sql_clean('reply')} AS answer
FROM both_ways WHERE length(ask) > 5 AND reply <> ''""")
def faq_legacy(spark, sf):
    found = faqs.faq_legacy(inputs.faq_lists(spark, sf))
    turn = F.regexp_extract("url", r"t=(\d+)", 1).cast("bigint")
    return found.select("site", turn.alias("turn"), "question", "answer")


# ------------------------------------------------------------- the assembled record

MAIN_SQL = f"""
main AS (
  SELECT {HOST} AS site, url, html, {RANK} AS page_rank FROM pages
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_rank, url) = 1)
"""


@query("main_page_names", f"WITH {MAIN_SQL} SELECT site, url AS website_url, {NAME} AS brand_name FROM main")
def main_page_names(spark, sf):
    digest = assemble.page_digest(inputs.pages(spark, sf))
    return assemble.main_pages(digest).select("site", F.col("url").alias("website_url"), "brand_name")


def _record(insights):
    joined = {c: F.array_join(c, "|").alias(c) for c in ("currencies", "payment_methods")}
    return insights.select(
        "site", "website_url", "brand_name", "brand_description", "logo_url", *joined.values(), "on_platform", "category",
        F.array_join("contact_details.emails", "|").alias("emails"), F.col("contact_details.address").alias("address"),
        F.array_join(F.array_sort(F.map_keys("social_handles")), "|").alias("social"),
        F.array_join(F.array_sort(F.map_keys("important_links")), "|").alias("important"),
        F.col("privacy_policy.title").alias("privacy"), F.col("refund_policy.url").alias("refund_url"),
        F.array_join(F.transform("faqs", lambda f: f["question"]), "|").alias("questions"), "total_products",
    )


@query("assemble_insights", f"""
WITH {HOMES_SQL}
SELECT site, url AS website_url, {BRAND} AS brand_name, {DESCRIPTION} AS brand_description, base || '/logo-' || s_suppkey || '.png' AS logo_url,
  {CURRENCIES} AS currencies, 'Klarna|PayPal|Visa' AS payment_methods, true AS on_platform,
  CASE WHEN s_acctbal >= 5000 THEN 'fashion' ELSE 'ecommerce' END AS category,
  'help' || s_suppkey || '@shop' || s_suppkey || '.example.com' AS emails,
  s_suppkey || ' Long Street, ' || n_name || ', Region ' || s_nationkey AS address,
  CASE WHEN s_nationkey > 12 THEN 'instagram|twitter' ELSE 'instagram' END AS social,
  'about_us|blogs|contact_us|order_tracking|shipping_info' AS important, 'Privacy Policy' AS privacy,
  base || '/policies/refund-policy' AS refund_url,
  'How fast is shipping from ' || n_name || '?|Can I return goods to ' || s_name || '?' AS questions, 0 AS total_products FROM homes""")
def assemble_insights(spark, sf):
    insights, _ = assemble.build_insights(inputs.supplier_homes(spark, sf))
    return _record(insights)


@query("assemble_catalog", f"""
WITH {PARTS_SQL}, {FEED_SQL}, tagged AS (
  SELECT shop AS site, p_name, seq, row_number() OVER (PARTITION BY shop ORDER BY p_type <> 'PROMO', seq) AS r,
         bool_or(p_type = 'PROMO') OVER (PARTITION BY shop) AS home
  FROM feed_rows WHERE p_type IN ('PROMO', 'STANDARD', 'LARGE')),
hero AS (SELECT site, string_agg(p_name, '|' ORDER BY r) AS hero FROM tagged WHERE r <= CASE WHEN home THEN 10 ELSE 6 END GROUP BY 1)
SELECT shop AS site, count(*) AS total_products, any_value(hero) AS hero FROM parts LEFT JOIN hero ON shop = hero.site GROUP BY shop""")
def assemble_catalog(spark, sf):
    insights, _ = assemble.build_insights(inputs.shop_homes(spark, sf), inputs.shop_feeds(spark, sf))
    return insights.select(
        "site", "total_products", F.array_join(F.transform("hero_products", lambda p: p["name"]), "|").alias("hero")
    )
