"""Queries on competitors, the store tables and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import urls
from storelens.operators import competitors, ranking
from storelens.plans import analysis
from storelens.session import staging_root
from storelens.sources import store
from storelens.streaming import refresh
from storelens.suite import inputs, query
from storelens.suite.catalog import FEED_PRODUCTS_SQL
from storelens.suite.inputs import BRANDS_SQL, CANDIDATES_SQL, HOMES_SQL, HOST, SEARCHED_SQL, TOLD_SQL, render, sql_class

# Suppliers whose store page counts as one of the platform.
FLAGGED = "s_acctbal > 9000"


def flags(spark, sf):
    return inputs.table(spark, sf, "supplier").select(
        render("www.shop-{{s_suppkey}}.example.com").alias("site"), F.expr(FLAGGED).alias("on_platform")
    )


def verified(spark, sf):
    raw = inputs.candidates(spark, sf).withColumn("strategy", F.lit(0)).withColumn("source", F.lit("search"))
    return competitors.verify_candidates(raw, flags(spark, sf))


VERIFIED_SQL = f"""
{CANDIDATES_SQL}, verified AS (
  SELECT c.* FROM cands c JOIN supplier ON l_suppkey = s_suppkey WHERE {FLAGGED}
  QUALIFY engine_rank = min(engine_rank) OVER (PARTITION BY site, query_rank)),
unique_cands AS (
  SELECT * FROM verified QUALIFY row_number() OVER (PARTITION BY site, lower(name) ORDER BY query_rank, engine_rank, seq, url) = 1)
"""


@query("competitor_category", f"""
WITH {HOMES_SQL}, l AS (
  SELECT site, lower(concat_ws(' ', CASE WHEN s_acctbal >= 5000 THEN n_name || ' fashion & goods by ' || s_name END,
    s_name || ' - Official Store', 'It takes about ' || s_nationkey || ' days from ' || n_name || '.',
    'Some words that are not an answer', 'Yes, within ' || s_suppkey || ' days of delivery')) AS lead FROM homes)
SELECT site, {sql_class(rules.BRAND_CATEGORY_RULES, "'ecommerce'", 'lead')} AS category FROM l""")
def competitor_category(spark, sf):
    return competitors.competitor_category(inputs.supplier_homes(spark, sf)).select("site", "category")


@query("verify_candidates", f"WITH {VERIFIED_SQL} SELECT site, query_rank, engine_rank, seq, url, name FROM verified")
def verify_candidates(spark, sf):
    return verified(spark, sf).select("site", "query_rank", "engine_rank", "seq", "url", "name")


@query("dedup_candidates", f"WITH {VERIFIED_SQL} SELECT site, query_rank, seq, url, name FROM unique_cands")
def dedup_candidates(spark, sf):
    return competitors.dedup_candidates(verified(spark, sf)).select("site", "query_rank", "seq", "url", "name")


@query("dedup_candidates_by_host", f"""
WITH {CANDIDATES_SQL} SELECT site, query_rank, seq, url FROM cands
QUALIFY row_number() OVER (PARTITION BY site, host ORDER BY query_rank, engine_rank, seq, url) = 1""")
def dedup_candidates_by_host(spark, sf):
    return competitors.dedup_candidates_by_host(inputs.candidates(spark, sf)).select("site", "query_rank", "seq", "url")


@query("candidate_quota", f"""
WITH {CANDIDATES_SQL}, n AS (SELECT site, query_rank, count(*) AS n FROM cands GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY site ORDER BY query_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT site, query_rank, seq, url FROM cands JOIN b USING (site, query_rank) WHERE before < 20""")
def candidate_quota(spark, sf):
    return ranking.candidate_quota(inputs.candidates(spark, sf)).select("site", "query_rank", "seq", "url")


@query("union_candidates", f"""
WITH {CANDIDATES_SQL}, u AS (
  SELECT *, CASE seq % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS strategy FROM cands)
SELECT site, strategy, count(*) AS n, count(DISTINCT url) AS n_urls FROM u GROUP BY ALL""")
def union_candidates(spark, sf):
    raw = inputs.candidates(spark, sf)
    web, similar, industry = (raw.filter(F.pmod("seq", F.lit(3)) == r) for r in (1, 2, 0))
    both = competitors.union_candidates(web, similar, industry)
    return both.groupBy("site", "strategy").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


DIRECTORY_VALUES = ", ".join(f"({i}, '{c}', '{n}', '{u}')" for i, (c, n, u) in enumerate(rules.STORE_DIRECTORY))
FALLBACK_SQL = f"""
dir(seq, listed, name, url) AS (VALUES {DIRECTORY_VALUES}),
lonely AS (
  SELECT *, CASE WHEN category IN (SELECT listed FROM dir) THEN category ELSE 'default' END AS listed
  FROM brands WHERE site NOT IN (SELECT site FROM verified)),
fallback AS (SELECT site, seq, name, url, 'fallback' AS source FROM lonely JOIN dir USING (listed))
"""


@query("fallback_candidates", f"WITH {BRANDS_SQL}, {VERIFIED_SQL}, {FALLBACK_SQL} SELECT * FROM fallback")
def fallback_candidates(spark, sf):
    return competitors.fallback_candidates(inputs.brands(spark, sf), verified(spark, sf))


FOUND_SQL = f"""
{BRANDS_SQL}, {VERIFIED_SQL}, {FALLBACK_SQL}, found AS (
  SELECT site, name, url, 'search' AS source, row_number() OVER (PARTITION BY site ORDER BY query_rank, engine_rank, seq, url) AS rank
  FROM unique_cands WHERE site IN (SELECT site FROM brands) QUALIFY rank <= 10
  UNION ALL SELECT site, name, url, source, row_number() OVER (PARTITION BY site ORDER BY seq) FROM fallback)
"""


@query("find_competitors", f"WITH {FOUND_SQL} SELECT * FROM found")
def find_competitors(spark, sf):
    return competitors.find_competitors(inputs.brands(spark, sf), verified(spark, sf))


def records(spark, sf):
    """Store records of the suppliers with a positive nation key, under the host candidates use."""
    sold = inputs.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total_products"))
    suppliers = inputs.table(spark, sf, "supplier").join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    high = F.col("s_nationkey") > 12
    category = F.struct(
        F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.when(high, "Subscription").otherwise("General").alias("category"),
    )
    return suppliers.filter("s_nationkey > 0").select(
        render("www.shop-{{s_suppkey}}.example.com").alias("site"),
        "total_products",
        F.when(high, F.create_map(F.lit("twitter"), F.lit("t"), F.lit("instagram"), F.lit("i")))
        .otherwise(F.create_map(F.lit("instagram"), F.lit("i"))).alias("social_handles"),
        F.when(high, F.array(F.lit("Visa"), F.lit("Klarna"))).otherwise(F.array(F.lit("Visa"))).alias("payment_methods"),
        F.array(category).alias("faqs"),
    )


ANALYZED_SQL = f"""
{FOUND_SQL}, sold AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
records AS (
  SELECT 'www.shop-' || s_suppkey || '.example.com' AS host, coalesce(n, 0) AS products, s_nationkey > 12 AS high
  FROM supplier LEFT JOIN sold ON s_suppkey = l_suppkey WHERE s_nationkey > 0),
analyzed AS (
  SELECT site, name, rank, products, high, host IS NOT NULL AS analyzed
  FROM found LEFT JOIN records ON host = lower(regexp_extract(url, '^https?://([^/]+)', 1)))
"""


def analyzed(spark, sf):
    found = competitors.find_competitors(inputs.brands(spark, sf), verified(spark, sf))
    return competitors.competitor_insights(found, competitors.insight_stats(records(spark, sf)))


@query("competitor_insights", f"WITH {ANALYZED_SQL} SELECT site, name, rank, products, analyzed FROM analyzed")
def competitor_insights(spark, sf):
    return analyzed(spark, sf).select("site", "name", "rank", "products", "analyzed")


SUMMARY_SQL = f"""
{ANALYZED_SQL}, sizes AS (
  SELECT site, count(*) AS competitors_found, count(*) FILTER (WHERE analyzed) AS competitors_analyzed,
         coalesce(sum(products) // nullif(count(*) FILTER (WHERE analyzed), 0), 0) AS avg_products_per_store,
         count(*) FILTER (WHERE high) AS n_high FROM analyzed GROUP BY 1),
summary AS (
  SELECT site, coalesce(competitors_found, 0) AS competitors_found, coalesce(competitors_analyzed, 0) AS competitors_analyzed,
         coalesce(avg_products_per_store, 0) AS avg_products_per_store,
         CASE WHEN coalesce(competitors_analyzed, 0) = 0 THEN '' WHEN n_high > 0 THEN 'instagram:' || competitors_analyzed || '|twitter:' || n_high
              ELSE 'instagram:' || competitors_analyzed END AS social,
         CASE WHEN coalesce(competitors_analyzed, 0) = 0 THEN ''
              WHEN n_high = competitors_analyzed THEN 'Klarna:' || n_high || '|Visa:' || n_high
              WHEN n_high > 0 THEN 'Visa:' || competitors_analyzed || '|Klarna:' || n_high
              ELSE 'Visa:' || competitors_analyzed END AS payments,
         CASE WHEN coalesce(competitors_analyzed, 0) = 0 THEN ''
              WHEN n_high = competitors_analyzed THEN 'Subscription:' || n_high
              WHEN n_high = 0 THEN 'General:' || competitors_analyzed
              WHEN n_high > competitors_analyzed - n_high THEN 'Subscription:' || n_high || '|General:' || (competitors_analyzed - n_high)
              ELSE 'General:' || (competitors_analyzed - n_high) || '|Subscription:' || n_high END AS faq_categories,
         CASE WHEN coalesce(competitors_analyzed, 0) = 0 THEN 'No competitor insights available' END AS message
  FROM brands LEFT JOIN sizes USING (site))
"""


def _flat_summary(df):
    def shown(name, alias):
        return F.array_join(F.transform(name, lambda v: F.concat_ws(":", v["value"], v["cnt"].cast("string"))), "|").alias(alias)

    return df.select(
        "site", "competitors_found", "competitors_analyzed", "avg_products_per_store",
        shown("common_social_platforms", "social"), shown("common_payment_methods", "payments"),
        shown("common_faq_categories", "faq_categories"), "message",
    )


@query("competitor_summary", f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def competitor_summary(spark, sf):
    return _flat_summary(competitors.competitor_summary(analyzed(spark, sf), inputs.brands(spark, sf)))


@query("analyze_competitors", f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def analyze_competitors(spark, sf):
    result = analysis.analyze_competitors(inputs.brands(spark, sf), verified(spark, sf), records(spark, sf))
    return _flat_summary(result)


@query("candidates_from_search", f"""
WITH {SEARCHED_SQL} SELECT site, strategy, l_orderkey AS query_rank, engine_rank, seq, url, name FROM verified""")
def candidates_from_search(spark, sf):
    """Saved result pages of three engines, each longer than the engine's limit, checked against saved store pages."""
    found = analysis.candidates_from_search(inputs.search_pages(spark, sf), inputs.candidate_pages(spark, sf))
    return found.select("site", "strategy", "query_rank", "engine_rank", "seq", "url", "name")


SEARCHED_SUMMARY_SQL = SUMMARY_SQL.replace(BRANDS_SQL, TOLD_SQL).replace(VERIFIED_SQL, SEARCHED_SQL)


@query("competitors_from_search", f"""
WITH {SEARCHED_SUMMARY_SQL}, named AS (
  SELECT site, string_agg(name || '=' || url || '=' || products, '|' ORDER BY rank) AS records FROM (
    SELECT site, f.name, f.url, f.rank, r.products FROM found f JOIN records r ON host = lower(regexp_extract(url, '^https?://([^/]+)', 1))) GROUP BY 1)
SELECT summary.*, coalesce(records, '') AS records FROM summary LEFT JOIN named USING (site)""")
def competitors_from_search(spark, sf):
    """The whole job from saved pages to the summary and the records of the competitors."""
    result = analysis.competitors_from_search(
        inputs.brand_pages(spark, sf), inputs.brands(spark, sf).drop("category"), inputs.search_pages(spark, sf),
        inputs.candidate_pages(spark, sf), records(spark, sf), with_records=True,
    )
    total = lambda e: F.coalesce(F.get_json_object(e["insights"], "$.total_products"), F.lit("0"))
    shown = F.transform("competitor_insights", lambda e: F.concat_ws("=", e["competitor_name"], e["competitor_url"], total(e)))
    flat = _flat_summary(result)
    return flat.join(result.select("site", F.array_join(shown, "|").alias("records")), "site")


@query("store_summary", """
WITH sizes AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL),
per AS (SELECT l_suppkey, count(*) AS n_parts, sum(n) AS n_lines FROM sizes GROUP BY 1)
SELECT s_suppkey, coalesce(n_parts, 0) AS n_parts, n_lines // n_parts AS lines_per_part,
       CASE WHEN n_parts IS NULL THEN 'No competitor insights available' END AS message
FROM supplier LEFT JOIN per ON s_suppkey = l_suppkey""")
def store_summary(spark, sf):
    lines = inputs.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    per = lines.groupBy("l_suppkey").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_lines"))
    suppliers = inputs.table(spark, sf, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return suppliers.select(
        "s_suppkey", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.expr("n_lines div n_parts").alias("lines_per_part"),
        F.when(F.col("n_parts").isNull(), "No competitor insights available").alias("message"),
    )


def stored_analyses(spark, sf, condition="true"):
    """Two stored analyses per customer, a day apart."""
    customers = inputs.table(spark, sf, "customer").filter(condition)
    days = customers.withColumn("day", F.explode(F.array(F.lit(2), F.lit(1))))
    rows = days.select(
        render("c{{c_custkey}}.example.com").alias("site"), F.col("c_name").alias("original_brand"),
        F.col("day").cast("bigint").alias("competitors_found"), "day",
    )
    stamped = store.analysis_rows(rows, F.expr("timestamp '2024-01-01' + make_dt_interval(day)"))
    return stamped.drop("day")


@query("append_analysis", """
SELECT 'c' || c_custkey || '.example.com' AS site, c_name AS original_brand, '' AS original_url, day AS competitors_found,
       0 AS competitors_analyzed, TIMESTAMP '2024-01-01' + to_days(day) AS created_at
FROM customer, (VALUES (1), (2)) d(day)""")
def append_analysis(spark, sf):
    """Appended to a log of analyses in two runs, the first of them repeated as after a lost driver, and read back."""
    log, rows = store.AnalysisLog(spark, _folder(spark, "analyses")), stored_analyses(spark, sf)
    for run in (1, 1, 2):
        log.append(rows.filter(F.col("competitors_found") == run), f"day-{run}")
    return log.read().drop("analysis_id", "updated_at")


@query("lookup_analysis", """
SELECT 'c' || c_custkey || '.example.com' AS site, c_name AS original_brand, 2 AS competitors_found FROM customer""")
def lookup_analysis(spark, sf):
    return store.lookup_analysis(stored_analyses(spark, sf)).select("site", "original_brand", "competitors_found")


@query("reuse_or_compute", f"""
WITH {SUMMARY_SQL}
SELECT s.site, CASE WHEN stored THEN 2 ELSE s.competitors_found END AS competitors_found,
       CASE WHEN stored THEN 0 ELSE s.competitors_analyzed END AS competitors_analyzed,
       stored AS reused, true AS reused_again, NOT stored AS logged
FROM summary s JOIN (SELECT 'c' || c_custkey || '.example.com' AS site, c_mktsegment = 'FURNITURE' AS stored FROM customer) USING (site)""")
def reuse_or_compute(spark, sf):
    """Brands of one segment have a stored analysis; the others' are computed, appended to a log and found there by a second run."""
    log, brands = store.AnalysisLog(spark, _folder(spark, "reuse")), inputs.brands(spark, sf)
    stored, given = stored_analyses(spark, sf, "c_mktsegment = 'FURNITURE'"), (verified(spark, sf), records(spark, sf))
    first = analysis.analyze_with_reuse(brands, stored, *given, log=log)
    logged = log.read()
    again = analysis.analyze_with_reuse(brands, stored.unionByName(logged, allowMissingColumns=True), *given, log=log)
    return (
        first.select("site", "competitors_found", "competitors_analyzed", "reused")
        .join(again.select("site", F.col("reused").alias("reused_again")), "site")
        .join(logged.select("site", F.lit(True).alias("in_log")), "site", "left")
        .withColumn("logged", F.coalesce("in_log", F.lit(False))).drop("in_log")
    )


@query("fallback_by_region", """
SELECT n_name, r_name, s.n AS n_suppliers, c.n AS n_customers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey WHERE s.n IS NULL""")
def fallback_by_region(spark, sf):
    """Nations without a rich supplier fall back to their region: the anti and small-table join of the fallback rule."""
    rich = inputs.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    per = inputs.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    lonely = inputs.table(spark, sf, "nation").join(rich, "n_nationkey", "left_anti")
    region = inputs.table(spark, sf, "region")
    joined = lonely.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(per, "n_nationkey", "left")
    return joined.select("n_name", "r_name", F.lit(None).cast("bigint").alias("n_suppliers"), "n_customers")


# ------------------------------------------------------------- store tables


def store_rows(spark, sf, condition, **columns):
    customers = inputs.table(spark, sf, "customer").filter(condition)
    return customers.select(render("c{{c_custkey}}.example.com").alias("site"), *[c.alias(n) for n, c in columns.items()])


def current_store(spark, sf):
    first = F.expr("timestamp '2024-01-01'")
    return store_rows(
        spark, sf, "c_acctbal > 2000", brand_name=F.col("c_name"), brand_description=F.col("c_mktsegment"),
        payment_methods=F.array(F.lit("Visa"), F.col("c_mktsegment")), created_at=first, updated_at=first,
    )


def store_batch(spark, sf):
    """Two versions of the customers up to 5000: a new name, and payments that are empty for some."""
    rows = store_rows(
        spark, sf, "c_acctbal <= 5000", brand_name=F.concat(F.lit("v"), F.col("c_name")),
        payment_methods=F.when(F.col("c_mktsegment") == "FURNITURE", F.array().cast("array<string>")).otherwise(
            F.array(F.lit("PayPal"))
        ),
    )
    versions = rows.withColumn("n", F.explode(F.array(F.lit(2), F.lit(1))))
    return versions.select(
        "site", F.concat("brand_name", F.lit("-"), F.col("n").cast("string")).alias("brand_name"), "payment_methods",
        F.expr("timestamp '2024-02-01' + make_dt_interval(n)").alias("updated_at"),
    )


def upserted(spark, sf):
    return store.upsert_insights(current_store(spark, sf), store_batch(spark, sf), F.expr("timestamp '2024-03-01'"))


STORE_SQL = """
store AS (
  SELECT 'c' || c_custkey || '.example.com' AS site, CASE WHEN c_acctbal <= 5000 THEN 'v' || c_name || '-2' ELSE c_name END AS brand_name,
         CASE WHEN c_acctbal > 2000 THEN c_mktsegment END AS brand_description,
         CASE WHEN c_acctbal > 5000 THEN 'Visa|' || c_mktsegment WHEN c_mktsegment <> 'FURNITURE' THEN 'PayPal' END AS payment_methods,
         CASE WHEN c_acctbal > 2000 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-03-01' END AS created_at,
         CASE WHEN c_acctbal <= 5000 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at, c_acctbal FROM customer)
"""


@query("upsert_insights", f"WITH {STORE_SQL} SELECT * EXCLUDE (c_acctbal) FROM store")
def upsert_insights(spark, sf):
    return upserted(spark, sf).withColumn("payment_methods", F.array_join("payment_methods", "|"))


@query("store_table", f"""
WITH {STORE_SQL} SELECT * EXCLUDE (c_acctbal), true AS old_version_stays FROM store WHERE c_acctbal NOT BETWEEN 2500 AND 3000""")
def store_table(spark, sf):
    """The same rows through the stored table: two upserts, then a deletion; the version before it can still be read."""
    table = store.StoreTable(spark, _folder(spark, "stores"), buckets=16)
    table.upsert(current_store(spark, sf).drop(*store.STAMPS), F.expr("timestamp '2024-01-01'"))
    second = table.upsert(store_batch(spark, sf), F.expr("timestamp '2024-03-01'"))
    removed = table.delete(store_rows(spark, sf, "c_acctbal BETWEEN 2500 AND 3000"))
    before = table.read(before=second + 1).join(removed, "site", "left_semi").count()
    rows = table.read().withColumn("payment_methods", F.array_join("payment_methods", "|"))
    return rows.withColumn("old_version_stays", F.lit(before == removed.count()))


@query("lookup_insights", f"""
WITH {STORE_SQL} SELECT site, brand_name, coalesce(payment_methods, '') AS payment_methods FROM store WHERE c_acctbal BETWEEN 1000 AND 6000""")
def lookup_insights(spark, sf):
    keys = store_rows(spark, sf, "c_acctbal BETWEEN 1000 AND 6000")
    found = store.lookup_insights(upserted(spark, sf), keys)
    return found.select("site", "brand_name", F.array_join("payment_methods", "|").alias("payment_methods"))


@query("list_stores", f"WITH {STORE_SQL} SELECT site, brand_name, created_at, updated_at FROM store")
def list_stores(spark, sf):
    return store.list_stores(upserted(spark, sf)).drop("store_id")


@query("delete_insights", """
SELECT 'c' || c_custkey || '.example.com' AS site, c_acctbal <= 5000 AS deleted FROM customer WHERE c_acctbal > 2000""")
def delete_insights(spark, sf):
    kept, removed = store.delete_insights(current_store(spark, sf), store_batch(spark, sf))
    return kept.select("site", F.lit(False).alias("deleted")).unionByName(removed.select("site", F.lit(True).alias("deleted")))


@query("json_text_columns", f"WITH {STORE_SQL} SELECT site, brand_name, payment_methods FROM store")
def json_text_columns(spark, sf):
    rows = upserted(spark, sf).select("site", "brand_name", "payment_methods")
    again = store.from_text_columns(store.to_text_columns(rows), rows.schema)
    return again.select("site", "brand_name", F.array_join("payment_methods", "|").alias("payment_methods"))


# ------------------------------------------------------------- streams


def _folder(spark, name):
    """A folder of its own for each call, below the shared one."""
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stream_page_dedup", f"SELECT {HOST} AS site, url, length(html) AS n_chars FROM pages")
def stream_page_dedup(spark, sf):
    """Every page is delivered twice; the stream keeps one copy."""
    folder = _folder(spark, "pages")
    pages = inputs.table(spark, sf, "pages").select("url", "html", F.timestamp_seconds(F.col("page_id") + 86400).alias("fetched_at"))
    twice = pages.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    twice.write.parquet(f"{folder}/in")
    kept = refresh.stream_page_dedup(refresh.page_stream(spark, f"{folder}/in"), "1 day")
    done = (
        kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(urls.host_of(F.col("url")).alias("site"), "url", F.length("html").alias("n_chars"))


@query("stream_insights", f"""
WITH {HOMES_SQL} SELECT site, replace(s_name, '#', '') AS brand_name, base || '/logo-' || s_suppkey || '.png' AS logo_url,
  CASE WHEN s_nationkey > 12 THEN 'instagram|twitter' ELSE 'instagram' END AS social,
  'https://www.instagram.com/shop' || s_suppkey AS instagram,
  CASE WHEN s_nationkey > 12 THEN 'https://twitter.com/shop' || s_suppkey END AS twitter, 0 AS total_products FROM homes""")
def stream_insights(spark, sf):
    """Home pages arrive in two deliveries, an outdated one first."""
    folder = _folder(spark, "refresh")
    homes = inputs.supplier_homes(spark, sf)
    old = homes.select("url", F.lit("<html><head><title>Soon</title></head></html>").alias("html"))
    for day, pages in enumerate((old, homes)):
        stamped = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(86400 * day)))
        stamped.write.mode("append").parquet(f"{folder}/in")
    stream = refresh.page_stream(spark, f"{folder}/in", max_files=64)
    refresh.stream_insights(stream, f"{folder}/store", f"{folder}/cp").awaitTermination()
    current = store.StoreTable(spark, f"{folder}/store/insights").read()
    return current.select(
        "site", "brand_name", "logo_url", F.array_join(F.array_sort(F.map_keys("social_handles")), "|").alias("social"),
        *[F.col("social_handles")[slot].alias(slot) for slot in ("instagram", "twitter")],
        F.col("total_products").cast("int").alias("total_products"),
    )


# Shops of brands above 12 publish no feed; those with an even brand number have product pages that a sitemap names.
DELIVERED_SQL = f"""
{FEED_PRODUCTS_SQL}, numbered AS (SELECT *, CAST(regexp_extract(shop, 'brand-([0-9]+)-', 1) AS INTEGER) AS brand_no FROM parts),
carded AS (SELECT shop, handle, p_name, price AS price_text FROM numbered WHERE brand_no > 12 AND p_type IN ('SMALL', 'LARGE', 'MEDIUM')),
paged AS (SELECT shop, handle, p_name || ' page' AS p_name, price AS price_text FROM numbered WHERE brand_no > 12 AND brand_no % 2 = 0),
shop_catalog AS (
  SELECT site, name, product_url, price_text FROM feed_products WHERE CAST(regexp_extract(site, 'brand-([0-9]+)-', 1) AS INTEGER) <= 12
  UNION ALL SELECT shop, p_name, 'https://' || shop || '/products/' || handle, price_text FROM carded
  UNION ALL SELECT shop, p_name, 'https://' || shop || '/products/' || handle, price_text FROM paged)
"""


def delivered(spark, sf) -> str:
    """Folder of a store that has read pages, feeds and sitemaps of the shops from one stream.

    First come the feeds, all as they are except that each second page is still empty, and home pages without sections; then,
    later in time, the second feed pages, the sitemaps, the product pages and the home pages as they are, with an
    outdated empty copy of every feed page, which changes nothing.
    """
    folder = _folder(spark, "deliveries")
    brand_no = F.regexp_extract("url", r"brand-(\d+)-", 1).cast("int")
    feeds, homes = inputs.shop_feeds(spark, sf).filter(brand_no <= 12), inputs.shop_homes(spark, sf)
    second, nothing = F.col("url").endswith("page=2"), F.lit('{"products":[]}')
    rows = inputs.shops(spark, sf).withColumn("url", render("https://{{shop}}/products/{{handle}}")).filter((brand_no > 12) & (brand_no % 2 == 0))
    card = '<html><body><div class="product-card"><h3>{{p_name}} page</h3><span class="price">${{price}}</span><a href="/products/{{handle}}">More</a></div></body></html>'
    pages = rows.select("url", render(card).alias("html"))
    loc = render("<url><loc>{{url}}?variant=1</loc></url>")
    maps = rows.groupBy("shop").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body"))
    maps = maps.select(render("https://{{shop}}/sitemap.xml").alias("url"), "body")
    early = refresh.tagged(
        page=homes.withColumn("html", F.lit("<html><body>Soon</body></html>")), feed=feeds.withColumn("body", F.when(second, nothing).otherwise(F.col("body")))
    )
    late = refresh.tagged(page=homes.unionByName(pages), feed=feeds.filter(second), sitemap=maps)
    stale = refresh.tagged(feed=feeds.withColumn("body", nothing))
    dated = lambda rows, day: rows.withColumn("fetched_at", F.timestamp_seconds(F.lit(86400 * day)))
    for batch in (dated(early, 1), dated(late, 2).unionByName(dated(stale, 0))):
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = refresh.page_stream(spark, f"{folder}/in", schema=refresh.DELIVERY_SCHEMA)
        refresh.stream_insights(stream, f"{folder}/store", f"{folder}/cp", compact_every=2).awaitTermination()
    return f"{folder}/store"


@query("stream_catalog", f"""
WITH {DELIVERED_SQL}
SELECT site, name, product_url, price_text, 'https://' || site || '/' AS website_url, count(*) OVER (PARTITION BY site) AS total_products
FROM shop_catalog""")
def stream_catalog(spark, sf):
    """Catalog rows with the address and the total that the site's record has."""
    folder = delivered(spark, sf)
    catalog, records = (store.StoreTable(spark, f"{folder}/{name}").read() for name in ("catalog", "insights"))
    known = records.select("site", "website_url", "total_products")
    return catalog.select("site", "name", "product_url", "price_text").join(known, "site", "full_outer")
