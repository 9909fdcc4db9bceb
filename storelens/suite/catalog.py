"""Queries on products: feeds, structured data, cards, dedup, limits, featured products."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import urls
from storelens.operators import hero, products, ranking, relations
from storelens.sources import feeds
from storelens.suite import inputs, query
from storelens.suite.inputs import FEED_SQL, PARTS_SQL, SHOP_HERO_SQL

FLAT = ("name", "price_text", "original_price_text", "currency", "in_stock", "image_url", "product_url", "description")


def flat(df, *keys, without=()):
    """Scalar product columns; amounts as doubles and tags as text."""
    kept = [c for c in FLAT if c not in without]
    return df.select(
        *keys, *kept, F.col("price").cast("double").alias("price"), F.array_join("tags", "|").alias("tags")
    )


def feed_rows(spark, sf):
    return feeds.read_product_feed(inputs.shop_feeds(spark, sf))


def feed_products(spark, sf, **options):
    return products.products_from_feed(feed_rows(spark, sf), **options)


def part_products(spark, sf):
    """Parts as catalog rows of their brand: the words of the name are the tags, two seasons of each part."""
    parts = inputs.parts(spark, sf).withColumn("url", F.lit("")).withColumn("page_rank", F.lit(0))
    rows = parts.withColumn("branch", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("seq", F.col("p_partkey"))
    return products.as_products(
        rows,
        name=F.when(F.col("branch") == 0, F.col("p_name")).otherwise(F.upper("p_name")),
        price_text=F.when(F.col("p_size") > 5, F.concat(F.lit("$"), F.col("price"))),
        image_url=F.when(F.col("p_size") > 20, F.concat(F.lit("/i/"), F.col("handle"))),
        product_url=F.when(F.col("p_type") != "SMALL", F.col("p_type")),
        description=F.when(F.col("p_size") > 40, F.col("p_type")),
        tags=F.split("p_name", " "),
    )


PART_PRODUCTS_SQL = f"""
{PARTS_SQL}, rows2 AS (
  SELECT site, 0 AS branch, p_partkey AS seq, p_name AS name, CASE WHEN p_type <> 'SMALL' THEN p_type END AS product_url,
         p_size, p_type, p_name FROM parts
  UNION ALL
  SELECT site, 1, p_partkey, upper(p_name), CASE WHEN p_type <> 'SMALL' THEN p_type END, p_size, p_type, p_name FROM parts)
"""


@query("read_product_feed", f"""
WITH {PARTS_SQL}, {FEED_SQL} SELECT shop AS site, base AS base_url, seq, p_name AS title, handle FROM feed_rows""")
def read_product_feed(spark, sf):
    return feed_rows(spark, sf).select(
        "site", "base_url", "seq", F.col("product.title").alias("title"), F.col("product.handle").alias("handle")
    )


FEED_PRODUCTS_SQL = f"""
{PARTS_SQL}, {FEED_SQL}, feed_products AS (
  SELECT shop AS site, seq, p_name AS name, '$' || price AS price_text, CASE WHEN p_size > 30 THEN '$' || old_price END AS original_price_text,
         CAST(NULL AS VARCHAR) AS currency, p_size <= 45 AS in_stock,
         CASE WHEN p_type <> 'SMALL' THEN '/img/' || p_partkey || '.png' END AS image_url,
         base || '/products/' || handle AS product_url, '<p>' || p_type || ' ' || p_name || '</p>' AS description,
         CAST(price AS DOUBLE) AS price, tags, base, p_type, p_size FROM feed_rows)
"""


@query("products_from_feed", f"""
WITH {FEED_PRODUCTS_SQL} SELECT * EXCLUDE (base, p_type, p_size) FROM feed_products""")
def products_from_feed(spark, sf):
    return flat(feed_products(spark, sf), "site", "seq")


@query("products_from_feed_hero", f"""
WITH {FEED_PRODUCTS_SQL}
SELECT site, seq, name, price_text, original_price_text, currency, in_stock, base || image_url AS image_url, product_url,
       regexp_replace(description, '[<>/]', '', 'g') AS description, price, lower(tags) AS tags FROM feed_products""")
def products_from_feed_hero(spark, sf):
    return flat(feed_products(spark, sf, style="hero"), "site", "seq")


LD_SQL = f"""
{PARTS_SQL}, ld AS (
  SELECT site, url, p_name || ' ' || p_partkey AS name, CASE WHEN p_size = 50 THEN 'ask us' ELSE price END AS offer,
         CASE WHEN p_type = 'PROMO' THEN 'EUR' ELSE 'USD' END AS cur, p_type <> 'ECONOMY' AS in_stock,
         CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN base || '/img/' || p_partkey || '.png'
              ELSE 'https://cdn.example.com/' || p_partkey || '.png' END AS image_url,
         base || '/products/' || handle AS product_url, p_type || ' ' || p_name || '  more' AS description,
         CASE WHEN p_size <> 50 THEN CAST(price AS DOUBLE) END AS price FROM part_pages),
ld_products AS (
  SELECT site, url, name, CASE WHEN offer = 'ask us' THEN offer WHEN cur = 'EUR' THEN offer || ' EUR' ELSE '$' || offer END AS price_text,
         cur AS currency, in_stock, image_url, product_url, description, price FROM ld)
"""


def ld_items(spark, sf):
    return relations.structured_items(inputs.product_pages(spark, sf))


@query("products_from_jsonld", f"WITH {LD_SQL} SELECT * FROM ld_products")
def products_from_jsonld(spark, sf):
    return flat(products.products_from_jsonld(ld_items(spark, sf)), "site", "url", without=["original_price_text"]).drop("tags")


@query("products_from_jsonld_legacy", f"""
WITH {LD_SQL}
SELECT site, url, name, cur || ' ' || offer AS price_text, cur AS currency, in_stock, image_url, description, price FROM ld""")
def products_from_jsonld_legacy(spark, sf):
    found = products.products_from_jsonld_legacy(ld_items(spark, sf))
    return flat(found, "site", "url", without=["original_price_text", "product_url"]).drop("tags")


CARD_SQL = f"""
{PARTS_SQL}, cards AS (
  SELECT site, url, p_name || ' box ' || p_partkey AS name, price AS price_text, old_price AS original_price_text, 'USD' AS currency,
         p_size <= 40 AS in_stock, base || '/img/' || p_partkey || '.png' AS image_url,
         base || '/products/' || handle || '-box' AS product_url,
         'A ' || p_type || ' ' || p_name || ' of size ' || p_size || ', boxed' AS description, CAST(price AS DOUBLE) AS price,
         p_type || '|size ' || p_size AS tags, base, p_partkey, p_size FROM part_pages)
"""


@query("products_from_cards", f"WITH {CARD_SQL} SELECT * EXCLUDE (base, p_partkey, p_size) FROM cards")
def products_from_cards(spark, sf):
    return flat(ranking.first_per_key(products.products_from_cards(inputs.product_pages(spark, sf)),
                                      ["site", "url"], ["branch", "seq"]), "site", "url")


@query("products_from_cards_hero", f"WITH {CARD_SQL} SELECT * EXCLUDE (base, p_partkey, p_size, tags) FROM cards")
def products_from_cards_hero(spark, sf):
    found = products.products_from_cards(inputs.product_pages(spark, sf), style="hero")
    return flat(ranking.first_per_key(found, ["site", "url"], ["branch", "seq"]), "site", "url").drop("tags")


@query("products_from_cards_legacy", f"""
WITH {CARD_SQL}
SELECT site, url, name, '$' || price_text AS price_text, '€' || original_price_text AS original_price_text, currency,
       p_size <= 40 AS in_stock, base || '/blank.png' AS image_url, product_url, price FROM cards""")
def products_from_cards_legacy(spark, sf):
    found = products.products_from_cards(inputs.product_pages(spark, sf), style="legacy")
    return flat(found, "site", "url", without=["description"]).drop("tags")


@query("availability_text", "SELECT p_partkey, p_size <= 40 AND p_type <> 'PROMO' AS in_stock FROM part")
def availability_text(spark, sf):
    said = F.array(
        F.when(F.col("p_size") > 40, "Sold out today").when(F.col("p_type") == "SMALL", "Available now").otherwise("see"),
        F.when(F.col("p_type") == "PROMO", "Out of season"),
    )
    return inputs.table(spark, sf, "part").select("p_partkey", products.availability_text(said).alias("in_stock"))


@query("product_from_link", f"""
WITH {PARTS_SQL}
SELECT site, CASE WHEN p_type = 'PROMO' THEN 'Title ' || p_partkey WHEN p_type = 'SMALL' THEN 'See ' || p_name
         ELSE upper(p_name[1:1]) || regexp_extract(p_name, '^.([a-z]*) ', 1) || ' ' || upper(regexp_extract(p_name, ' (.)', 1))
              || regexp_extract(p_name, ' .(.*)$', 1) || ' ' || p_partkey END AS name,
       base || '/products/' || handle AS product_url, base || '/i/' || p_partkey || '.png' AS image_url FROM part_pages""")
def product_from_link(spark, sf):
    anchor = F.concat(
        inputs.render('<p><a href="/products/{{handle}}"'),
        F.when(F.col("p_type") == "PROMO", inputs.render(' title="Title {{p_partkey}}"')).otherwise(""),
        inputs.render('><img data-src="/i/{{p_partkey}}.png">'),
        F.when(F.col("p_type") == "SMALL", inputs.render("See <b>{{p_name}}</b>")).otherwise(""),
        F.lit("</a><a href='/about'>x</a></p>"),
    )
    pages = inputs.parts(spark, sf).select(inputs.render("https://{{site}}/l/{{p_partkey}}").alias("url"), anchor.alias("html"))
    found = products.product_from_link(relations.links(pages))
    return found.select("site", "name", "product_url", "image_url")


@query("union_products", f"""
WITH {LD_SQL}, {CARD_SQL.split(PARTS_SQL)[1].lstrip(', ')}
SELECT site, url, 0 AS branch, name, price_text, product_url FROM ld_products
UNION ALL SELECT site, url, 1, name, price_text, product_url FROM cards""")
def union_products(spark, sf):
    return products.union_products(inputs.product_pages(spark, sf)).select(
        "site", "url", "branch", "name", "price_text", "product_url"
    )


@query("single_product", f"WITH {LD_SQL} SELECT site, url, name, price_text FROM ld_products")
def single_product(spark, sf):
    return products.single_product(inputs.product_pages(spark, sf)).select("site", "url", "name", "price_text")


def _dedup_sql(keys):
    return f"""
WITH {PART_PRODUCTS_SQL}
SELECT site, branch, seq, name FROM rows2
QUALIFY row_number() OVER (PARTITION BY site, {keys} ORDER BY branch, seq) = 1"""


@query("dedup_products", _dedup_sql("lower(name), coalesce(product_url, '')"))
def dedup_products(spark, sf):
    return ranking.dedup_products(part_products(spark, sf)).select("site", "branch", "seq", "name")


@query("dedup_products_exact", _dedup_sql("name, coalesce(product_url, '')"))
def dedup_products_exact(spark, sf):
    return ranking.dedup_products_exact(part_products(spark, sf)).select("site", "branch", "seq", "name")


@query("dedup_products_legacy", _dedup_sql("name"))
def dedup_products_legacy(spark, sf):
    return ranking.dedup_products_legacy(part_products(spark, sf)).select("site", "branch", "seq", "name")


@query("limit_per_site", f"""
WITH {PART_PRODUCTS_SQL} SELECT site, branch, seq, name FROM rows2
QUALIFY row_number() OVER (PARTITION BY site ORDER BY branch, seq) <= 50""")
def limit_per_site(spark, sf):
    return ranking.limit_per_site(part_products(spark, sf), 50).select("site", "branch", "seq", "name")


@query("union_branches", """
WITH two AS (
  SELECT p_partkey, 0 AS branch, CAST(0 AS BIGINT) AS place FROM part
  UNION ALL SELECT l_partkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem)
SELECT p_partkey, branch, place FROM two QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY branch DESC, place) = 1""")
def union_branches(spark, sf):
    listed = inputs.table(spark, sf, "part").select("p_partkey", F.lit(0).alias("branch"), F.lit(0).cast("bigint").alias("place"))
    sold = inputs.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("branch"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
    )
    return ranking.first_per_key(listed.unionByName(sold), ["p_partkey"], [F.col("branch").desc(), "place"])


# Words of the part names that stand for featured tags.
NAME_TAGS = ("hot", "new", "ring", "widget")


@query("hero_by_tag", f"""
WITH {PART_PRODUCTS_SQL} SELECT site, branch, seq, name FROM rows2
WHERE list_has_any(string_split(p_name, ' '), ['hot', 'new', 'ring', 'widget'])""")
def hero_by_tag(spark, sf):
    return hero.hero_by_tag(part_products(spark, sf), NAME_TAGS).select("site", "branch", "seq", "name")


@query("hero_relevance", f"""
WITH {PART_PRODUCTS_SQL}
SELECT site, branch, seq, 10 * len(list_intersect(string_split(p_name, ' '), ['hot', 'new', 'ring', 'widget']))
       + CASE WHEN p_size > 20 THEN 10 ELSE 0 END + CASE WHEN p_size > 5 THEN 5 ELSE 0 END + CASE WHEN p_size > 40 THEN 5 ELSE 0 END AS score
FROM rows2 WHERE list_has_any(string_split(p_name, ' '), ['hot', 'new', 'ring', 'widget'])""")
def hero_relevance(spark, sf):
    return hero.hero_relevance(part_products(spark, sf), NAME_TAGS).select("site", "branch", "seq", "score")


@query("hero_products", f"""
WITH {FEED_PRODUCTS_SQL}, tagged AS (
  SELECT site, seq, name, product_url, CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END AS tag_rank
  FROM feed_products WHERE p_type IN ('PROMO', 'STANDARD', 'LARGE')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY tag_rank, seq) AS hero_rank,
         min(tag_rank) OVER (PARTITION BY site) AS best FROM tagged)
SELECT site, name, product_url, hero_rank FROM ranked WHERE hero_rank <= CASE WHEN best = 0 THEN 10 ELSE 6 END""")
def hero_products(spark, sf):
    catalog = feed_products(spark, sf, style="hero")
    return hero.hero_products(catalog).select("site", "name", "product_url", "hero_rank")


HERO_UNIQUE_SQL = f"""
{PARTS_SQL}, {SHOP_HERO_SQL}, hero_unique AS (
  SELECT * FROM hero_rows QUALIFY row_number() OVER (PARTITION BY site, lower(name), product_url ORDER BY kind, by_link, p_partkey) = 1)
"""


@query("union_hero", f"""
WITH {PARTS_SQL}, {SHOP_HERO_SQL} SELECT site, kind, name, price_text, image_url, product_url FROM hero_rows""")
def union_hero(spark, sf):
    found = hero.union_hero(inputs.shop_homes(spark, sf))
    return found.select(
        "site", F.floor(F.col("branch") / 100).cast("int").alias("kind"), "name", "price_text", "image_url", "product_url"
    )


@query("hero_position", f"""
WITH {HERO_UNIQUE_SQL}, placed2 AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY kind, by_link, p_partkey) - 1 AS i FROM hero_unique),
scored AS (
  SELECT *, 100 - i + CASE WHEN image_url IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN price_text IS NOT NULL THEN 15 ELSE 0 END AS score FROM placed2)
SELECT site, name, product_url, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, i) AS hero_rank
FROM scored QUALIFY hero_rank <= 6""")
def hero_position(spark, sf):
    return hero.hero_position(inputs.shop_homes(spark, sf)).select("site", "name", "product_url", "score", "hero_rank")


# The shop home page holds cards of four part types; brands above 12 publish no feed.
def some_feed(spark, sf, **options):
    return feed_products(spark, sf, **options).filter(F.regexp_extract("site", r"brand-(\d+)-", 1).cast("int") <= 12)


PAGE_PRODUCTS_SQL = f"""
{FEED_PRODUCTS_SQL}, page_cards AS (
  SELECT shop AS site, CAST(NULL AS BIGINT) AS seq, p_name AS name, 'https://' || shop || '/products/' || handle AS product_url,
         p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END AS kind
  FROM parts WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM')),
banner_one AS (
  SELECT shop AS site, arg_min(handle, p_partkey) AS handle FROM parts WHERE p_type = 'PROMO' GROUP BY 1),
with_feed AS (SELECT * FROM feed_products WHERE CAST(regexp_extract(site, 'brand-([0-9]+)-', 1) AS INTEGER) <= 12)
"""


@query("catalog_with_fallback", f"""
WITH {PAGE_PRODUCTS_SQL}
SELECT site, name, product_url FROM with_feed
UNION ALL SELECT site, name, product_url FROM page_cards WHERE site NOT IN (SELECT site FROM with_feed)""")
def catalog_with_fallback(spark, sf):
    from_pages = products.union_products(inputs.shop_homes(spark, sf)).filter(F.col("name") != "")
    return products.catalog_with_fallback(some_feed(spark, sf), from_pages).select("site", "name", "product_url")


@query("hero_catalog_html", f"""
WITH {PAGE_PRODUCTS_SQL}, cut AS (
  SELECT * FROM page_cards WHERE site NOT IN (SELECT site FROM with_feed)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY kind, p_partkey) <= 20)
SELECT site, name, product_url FROM with_feed UNION ALL SELECT site, name, product_url FROM cut""")
def hero_catalog_html(spark, sf):
    found = hero.hero_catalog_html(some_feed(spark, sf), inputs.shop_homes(spark, sf), 20)
    return found.select("site", "name", "product_url")


@query("total_products", f"WITH {PARTS_SQL} SELECT shop AS site, count(*) AS total_products FROM parts GROUP BY 1")
def total_products(spark, sf):
    return products.total_products(feed_products(spark, sf))


@query("product_urls", f"""
WITH {PARTS_SQL}, listed AS (
  SELECT shop AS site, 'https://' || shop || '/products/' || handle AS product_url FROM parts WHERE p_type IN ('SMALL', 'LARGE', 'PROMO', 'MEDIUM')
  UNION SELECT shop, 'https://' || shop || '/products/all-' || handle FROM parts WHERE p_type = 'ECONOMY'
  UNION SELECT shop, 'https://' || shop || '/products/' || handle FROM parts)
SELECT site, product_url FROM listed QUALIFY row_number() OVER (PARTITION BY site ORDER BY product_url) <= 100""")
def product_urls(spark, sf):
    rows = inputs.shops(spark, sf)

    def listing(path, prefix):
        links = F.array_join(F.collect_list(inputs.render(f'<a href="/products/{prefix}-{{{{handle}}}}">x</a>')), "")
        economy = rows.filter("p_type = 'ECONOMY'").groupBy("shop").agg(links.alias("html"))
        return economy.select(inputs.render(f"https://{{{{shop}}}}{path}").alias("url"), "html")

    # /collections is only read where /collections/all names no product.
    pages = inputs.shop_homes(spark, sf).unionByName(listing("/collections/all", "all")).unionByName(listing("/collections", "other"))
    sitemap = rows.select(F.col("shop").alias("site"), inputs.render("https://{{shop}}/products/{{handle}}").alias("loc"))
    return products.product_urls(pages, sitemap)


@query("fallback_products", f"""
WITH {LD_SQL}, {CARD_SQL.split(PARTS_SQL)[1].lstrip(', ')}, chosen AS (
  SELECT DISTINCT site, url FROM part_pages)
SELECT site, url, name FROM ld_products JOIN chosen USING (site, url)
UNION ALL SELECT site, url, name FROM cards JOIN chosen USING (site, url)""")
def fallback_products(spark, sf):
    """Sites known by their sitemap only: the products of all their product pages."""
    pages = inputs.product_pages(spark, sf)
    locs = pages.select(urls.host_of(F.col("url")).alias("site"), F.col("url").alias("loc"))
    homes = relations.with_site(pages).filter("page_rank = 0")  # none of the sites has one
    found = products.fallback_products(pages, homes, locs)
    return found.select("site", "url", "name")

