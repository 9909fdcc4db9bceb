"""Single odd rows, repeated snapshots and quoted tag ends, which once ended jobs or lost rows."""

import json

import pytest
from pyspark.sql import functions as F

from storelens.operators import brand, competitors, products, ranking, relations
from storelens.plans import assemble
from storelens.sources import feeds, pages as page_source, store

BODY = json.dumps({"products": [{"title": "A", "handle": "a"}, {"title": "B", "handle": "b"}]})


def test_a_huge_page_number_sorts_last(spark):
    rows = [("https://s.com/products.json?page=99999999999999", BODY), ("https://s.com/products.json?page=2", BODY),
            ("https://s.com/products.json?page=" + "9" * 40, BODY)]
    found = feeds.read_product_feed(spark.createDataFrame(rows, "url string, body string"))
    seqs = {(r.url, r.title): r.seq for r in found.select("url", "seq", F.col("product.title").alias("title")).collect()}
    assert len(seqs) == 6 and seqs[rows[1][0], "A"] == 2_000_000
    assert seqs[rows[0][0], "A"] > 10**18 and seqs[rows[0][0], "B"] > seqs[rows[0][0], "A"]


def test_many_blocks_of_structured_data(spark, pages):
    blocks = "".join(f'<script type="application/ld+json">[{{"n": {i}}}, {{"n": {i}}}]</script>' for i in range(2300))
    found = relations.structured_items(pages(("https://s.com/", f"<html>{blocks}</html>")))
    rows = found.select("seq", F.expr("try_variant_get(item, '$.n', 'int')").alias("n")).orderBy("seq").collect()
    assert [r.n for r in rows] == [i for i in range(2300) for _ in range(2)]


def test_quoted_tag_ends(pages):
    page = ("<a data-x=\"a>b\" href='/pages/contact'>Contact</a><a title='x > y' href=\"/b\"><b>B</b></a><img alt='1>0' src='/i.png'>"
            "<form data-y=\"p>q\" action='/go'></form><a href=/c title=\"open>C</a>")
    given = pages(("https://s.com/", page))
    assert [(r.href, r.text) for r in relations.links(given).orderBy("seq").collect()] == [("/pages/contact", "Contact"), ("/b", "B"), ("/c", "C")]
    assert [r.src for r in relations.images(given).collect()] == ["/i.png"]
    assert [r.action for r in relations.forms(given).collect()] == ["/go"]


@pytest.mark.parametrize("turned", [False, True])
def test_the_newest_snapshot_counts(spark, turned):
    rows = [("https://s.com/", "<title>Old</title><p>x</p>", 1), ("https://s.com/", "<title>New</title><p>x</p>", 3), ("https://s.com/", "<title>None</title><p>x</p>", None),
            ("https://t.com/", "<title>One</title>", None), ("https://u.com/", "<title>A</title>", 2)]
    given = spark.createDataFrame(rows[::-1] if turned else rows, "url string, html string, day int").select(
        "url", "html", F.timestamp_seconds(F.col("day") * 86400).alias("fetched_at"))
    assert sorted(r.html for r in page_source.current_pages(given).collect()) == sorted(r[1] for r in (rows[1], rows[3], rows[4]))
    insights, _ = assemble.build_insights(given)
    assert {r.site: r.brand_name for r in insights.collect()} == {"s.com": "New", "t.com": "One", "u.com": "A"}


def test_sites_with_feeds_only_have_no_record(spark, pages):
    given = spark.createDataFrame([("https://feed.com/products.json", BODY)], "url string, body string")
    insights, catalog = assemble.build_insights(pages(("https://s.com/", "<title>S</title>")), given)
    assert [r.site for r in insights.collect()] == ["s.com"] and {r.site for r in catalog.collect()} == {"feed.com"}


def test_each_strategy_has_its_quota(spark):
    rows = [("s", strategy, rank, i) for strategy in (0, 1) for rank in (0, 1, 2) for i in range(15)]
    found = ranking.candidate_quota(spark.createDataFrame(rows, "site string, strategy int, query_rank int, seq int"), 20)
    assert sorted({(r.strategy, r.query_rank) for r in found.collect()}) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_a_frequent_competitor_joins_once_per_brand(spark):
    brands = spark.range(4000).select(F.concat(F.lit("b"), "id").alias("site"), F.when(F.col("id") % 3 > 0, "https://hot.com").otherwise(F.concat(F.lit("https://c"), F.col("id") % 50, F.lit(".com"))).alias("url"))
    stats = spark.createDataFrame([("hot.com", 7), ("c3.com", 5)], "competitor_site string, products int")
    found = competitors.competitor_insights(brands, stats)
    assert found.count() == 4000 and found.filter("products = 7").count() == brands.filter("url = 'https://hot.com'").count()
    assert found.filter("analyzed").count() == found.filter("products is not null").count()


def test_the_log_of_analyses_repeats_a_run_without_doubling(spark, tmp_path):
    log = store.AnalysisLog(spark, str(tmp_path / "log"))
    for run, site in (("a", "x"), ("a", "x"), ("b", "y")):
        log.append(spark.createDataFrame([(site, 1)], "site string, n int"), run)
    assert sorted(r.site for r in log.read().collect()) == ["x", "y"]


def test_product_pages_are_found_under_other_spellings(spark, pages):
    block = '<script type="application/ld+json">{"@type": "Product", "name": "%s"}</script>'
    given = relations.with_site(pages(
        ("https://www.s.com/", '<a href="https://s.com/products/a/">A</a><a href="/products/b?ref=1">B</a><a href="/products/gone">C</a>'),
        ("https://www.s.com/products/a", block % "A"), ("https://www.s.com/products/b/", block % "B"), ("https://www.s.com/products/z", block % "Z"),
    ))
    main = given.filter("page_rank = 0")
    assert sorted(r.name for r in products.fallback_products(given, main).collect() if r.name in ("A", "B", "Z") and "/products/" in r.url) == ["A", "B"]
    one = products.fallback_products(given, main, page_limit=1).filter(F.col("url").contains("/products/"))
    assert one.count() == 1


def test_one_snapshot_of_each_url_stays(spark):
    rows = [("https://a.com/", "x", 1), ("https://a.com/", "y", 1), ("https://a.com/", "x", 0), ("https://b.com/", "same", 2), ("https://b.com/", "same", 2),
            ("https://c.com/", "p", None), ("https://c.com/", "q", None), ("https://d.com/", "alone", 5)]
    given = spark.createDataFrame(rows, "url string, html string, day int").select("url", "html", F.timestamp_seconds(F.col("day") * 86400).alias("fetched_at"))
    want = sorted([("https://a.com/", "x"), ("https://b.com/", "same"), ("https://c.com/", "p"), ("https://d.com/", "alone")])  # greatest MD5 of a tie
    for frame in (given, given.orderBy(F.col("html").desc()).repartition(3)):
        assert sorted((r.url, r.html) for r in page_source.current_pages(frame).collect()) == want
    assert page_source.current_pages(given.drop("fetched_at")).count() == 4 and page_source.current_pages(given.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_only_needed_pages_are_read(spark, monkeypatch, broadcast):
    monkeypatch.setattr(page_source, "BROADCAST_URLS", broadcast)
    rows = [("https://a.com/", "home"), ("https://a.com/blog/x", "no"), ("https://a.com/products/p", "product"), ("https://a.com/pages/faq", "faq"),
            ("https://b.com/x/y", "first"), ("https://b.com/x/z", "no"), ("https://c.com/", ""), ("https://c.com/deep/er", "stands in"), ("https://c.com/deep/est/p", "also"),
            ("https://d.com/only", None), ("nonsense", "no"), (None, "no")]
    found = page_source.needed_pages(spark.createDataFrame(rows, "url string, html string"), ("/pages/faq",), ("/products/",))
    assert sorted(r.html for r in found.collect()) == ["also", "faq", "first", "home", "product", "stands in"]
    insights, _ = assemble.build_insights(spark.createDataFrame(rows[:7] + [(rows[7][0], "<title>Stands in</title>")], "url string, html string"))
    assert {r.site: r.website_url for r in insights.collect()} == {"a.com": "https://a.com/", "b.com": "https://b.com/x/y", "c.com": "https://c.com/deep/er"}


def test_pages_are_chosen_without_their_text(spark, tmp_path):
    spark.createDataFrame([("https://a.com/x", "text")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    given = spark.read.parquet(str(tmp_path / "pages"))
    staged = []
    kept = page_source.stage
    page_source.stage = lambda df, name: staged.append(df) or kept(df, name)
    try:
        page_source.needed_pages(given)
    finally:
        page_source.stage = kept
    assert "ReadSchema: struct<url:string>" in staged[0]._jdf.queryExecution().executedPlan().toString()


def test_quoted_tag_ends_in_meta_headings_icons_and_forms(pages):
    page = ("<head><meta content='Shop > Women' name=description><meta property='og:description' content=\"a > b\"></head>"
            "<img alt='a > b' src='/visa-payment-icon.png'><form data-x='p > q' action='/contact'></form><h2 title='x > y'>Head</h2>after")
    given = pages(("https://s.com/", page))
    meta = relations.page_meta(given).first()
    assert (meta.description, meta.og_description) == ("Shop > Women", "a > b")
    assert [(r.level, r.heading, r.block) for r in relations.headings(given).collect()] == [(2, "Head", "after")]
    assert brand.contacts(given).first().contact_form_url and "Visa" in brand.payment_methods(given).first().payment_methods


def test_rendered_pages_are_dealt_to_all_cores(spark):
    """Pages rendered from a table of one small file are not left to one task."""
    from storelens.suite import inputs

    for pages in (inputs.product_pages(spark, "/root/testdata/sf0.001"), inputs.supplier_homes(spark, "/root/testdata/sf0.001")):
        used = pages.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism
