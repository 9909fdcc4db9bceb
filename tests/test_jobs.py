"""Whole jobs: ranking under skew, joins with hot keys, the store, competitors, streams, plan shape."""

import pytest
from pyspark.sql import functions as F

from storelens.operators import competitors, products, ranking, relations
from storelens.operators.registry import OPERATORS
from storelens.plans import analysis, assemble
from storelens.sources import store
from storelens.streaming import refresh
from storelens.suite import inputs

def now():
    return F.expr("timestamp '2024-03-01'")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (n % 40).cast("string"))).alias("site"),
        F.lit(0).alias("branch"), F.lit(0).alias("page_rank"), F.lit("u").alias("url"), n.alias("seq"),
        F.concat(F.lit("Name "), (n % 70).cast("string")).alias("name"),
        F.when(n % 5 > 0, F.concat(F.lit("/p/"), (n % 7).cast("string"))).alias("product_url"),
    )


def brute_first(df, key):
    best = {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        best.setdefault(key(r), r.seq)
    return sorted(best.values())


def test_dedup_keeps_the_first_and_is_idempotent(skewed):
    keys = {
        "default": lambda r: (r.site, r.name.lower(), r.product_url or ""),
        "exact": lambda r: (r.site, r.name, r.product_url or ""),
        "legacy": lambda r: (r.site, r.name),
    }
    for style, key in keys.items():
        once = ranking.dedup_products(skewed, style)
        assert [s for (s,) in rows(once, "seq")] == brute_first(skewed, key)
        assert rows(ranking.dedup_products(once, style)) == rows(once)


def test_results_do_not_depend_on_partitions(skewed):
    few, many = skewed.repartition(1), skewed.repartition(7, "name")
    assert rows(ranking.dedup_products(few)) == rows(ranking.dedup_products(many))
    assert rows(ranking.limit_per_site(few, 9)) == rows(ranking.limit_per_site(many, 9))
    assert rows(ranking.top_k_values(few, ["site"], "name", 3)) == rows(ranking.top_k_values(many, ["site"], "name", 3))


def test_limits_hold_and_are_cut_before_the_shuffle(skewed):
    limited = ranking.limit_per_site(skewed, 9)
    assert limited.groupBy("site").count().agg(F.max("count")).first()[0] == 9
    shape = plan(limited)
    assert shape.index("Final") < shape.index("Exchange hashpartitioning") < shape.index("Partial")
    partial = plan(ranking.first_wins(skewed, ["site", "name"], "product_url", ["seq"]))
    assert "partial_min_by" in partial


def test_quota_counts_whole_queries(spark):
    found = [("a", q, i) for q, n in ((0, 12), (1, 7), (2, 5), (3, 1)) for i in range(n)] + [("b", 5, 0)]
    kept = ranking.candidate_quota(spark.createDataFrame(found, "site string, query_rank int, seq int"))
    assert rows(kept.groupBy("site", "query_rank").count()) == [("a", 0, 12), ("a", 1, 7), ("a", 2, 5), ("b", 5, 1)]


def test_python_runs_only_in_the_outline(pages):
    page = pages(("https://s.com/", "<a href='/x'>x</a>"))
    narrow = [relations.links(page), relations.page_text(page), relations.page_meta(page), relations.headings(page),
              products.products_from_jsonld(relations.structured_items(page))]
    assert not any("EvalPython" in plan(df) for df in narrow)
    digest = plan(assemble.page_digest(page))
    assert digest.count("EvalPython") == 1 and "page_outline" in digest and "Exchange" not in digest


CANDIDATES = "site string, strategy int, query_rank int, engine_rank int, seq int, url string, source string"


def test_candidates(spark):
    own = [
        ("me.com", 0, 0, 1, 0, "https://late.com", "s"), ("me.com", 0, 0, 0, 0, "https://www.good-shop.com/a", "s"),
        ("me.com", 0, 0, 0, 1, "https://me.com/x", "s"), ("me.com", 0, 0, 0, 2, "https://www.amazon.com", "s"),
        ("me.com", 0, 1, 2, 0, "https://off.com", "s"), ("me.com", 1, 0, 0, 0, "https://good-shop.com/b", "s"),
        ("me.com", 1, 0, 0, 1, "https://Third.com", "s"),
    ]
    flags = spark.createDataFrame(
        [("late.com", True), ("www.good-shop.com", True), ("good-shop.com", True), ("third.com", True), ("off.com", False)],
        "site string, on_platform boolean",
    )
    verified = competitors.verify_candidates(spark.createDataFrame(own, CANDIDATES), flags)
    assert rows(verified, "url") == [("https://Third.com",), ("https://good-shop.com/b",), ("https://www.good-shop.com/a",)]
    assert rows(competitors.dedup_candidates(verified), "name", "url") == [
        ("Good Shop", "https://www.good-shop.com/a"), ("Third", "https://Third.com"),
    ]
    brands = spark.createDataFrame(
        [("me.com", "home"), ("www.allbirds.com", "fashion"), ("alone.com", "pet")], "site string, category string"
    )
    found = competitors.find_competitors(brands, verified)
    got = rows(found, "site", "rank", "name", "source")
    assert got[:4] == [("alone.com", i + 1, n, "fallback") for i, n in enumerate(("Allbirds", "ColourPop", "Gymshark", "Bombas"))]
    assert got[4:6] == [("me.com", 1, "Good Shop", "s"), ("me.com", 2, "Third", "s")]
    assert [n for _, _, n, _ in got[6:]] == ["Everlane", "Bombas", "Outdoor Voices"]


def record(site, n, social, payments, faqs):
    return (site, n, {s: "u" for s in social}, payments, [("q", "a", c) for c in faqs])


def result_page(engine, query, links, strategy=0):
    cls = {"duckduckgo": "result__a", "bing": "b", "startpage": "w-gl__result-title"}[engine]
    html = "".join(f'<a class="{cls}" href="{u}">x</a>' for u in links)
    return ("me.com", strategy, query, engine, f"https://{engine}.org/{query}", html)


def test_competitors_from_saved_result_pages(spark):
    shops = [f"https://s{i}.com/" for i in range(60)]
    results = [
        # The first engine has no store on the platform among its first 15 links, so the second one counts.
        result_page("duckduckgo", 0, [f"https://off{i}.com" for i in range(15)] + shops[:1]),
        result_page("bing", 0, ["https://www.bing.com/x", "/more", *shops[:19]]),
        result_page("startpage", 0, shops[30:40]),
        result_page("startpage", 1, shops[18:36]),
        # 18 and 15 stores are enough: a third query of this strategy is not read, those of the others are.
        result_page("bing", 2, shops[40:45]),
        result_page("bing", 2, shops[45:47], strategy=1), result_page("bing", 3, shops[47:48], strategy=2),
        result_page("bing", 4, ["https://me.com/a", "https://www.facebook.com/p"], strategy=2),
    ]
    results = spark.createDataFrame(results, "site string, strategy int, query_rank int, engine string, url string, html string")
    pages = [(u, "<p>none</p>") for u in shops] + [(f"{u}cart", "<script src='//cdn.shopify.com/a.js'></script>") for u in shops]
    pages = spark.createDataFrame([*pages, ("https://www.facebook.com/", "shopify"), ("https://me.com/", "shopify")], "url string, html string")
    found = analysis.candidates_from_search(results, pages)
    number = F.regexp_extract("url", r"s(\d+)\.com", 1).cast("int")
    got = rows(found, "strategy", "query_rank", "source", number)
    want = [(0, 0, "search__search_bing", i) for i in range(18)] + [(0, 1, "search__search_startpage", i) for i in range(18, 33)]
    assert got == [*want, (1, 2, "search__search_bing", 45), (1, 2, "search__search_bing", 46), (2, 3, "search__search_bing", 47)]
    brands = spark.createDataFrame([("me.com", "Me"), ("solo.com", "Solo")], "site string, brand_name string")
    homes = spark.createDataFrame([("https://solo.com/", "<title>Gaming mice</title>"), ("https://solo.com/a", "<title>Makeup</title>")], "url string, html string")
    insights = spark.createDataFrame([record("s1.com", 5, ["x"], ["Visa"], []), record("s40.com", 9, [], [], [])], RECORD)
    result = {r.site: r for r in analysis.competitors_from_search(homes, brands, results, pages, insights, with_records=True).collect()}
    me, solo = result["me.com"], result["solo.com"]
    assert (me.competitors_found, me.competitors_analyzed, me.original_brand) == (10, 1, "Me")
    (held,) = me.competitor_insights
    assert (held.competitor_name, held.competitor_url) == ("S1", "https://s1.com/") and '"total_products":5' in held.insights
    assert (solo.competitors_found, solo.competitors_analyzed, solo.competitor_insights) == (4, 0, [])
    empty = analysis.candidates_from_search(results.limit(0), pages.limit(0))
    assert empty.count() == 0


RECORD = "site string, total_products bigint, social_handles map<string,string>, payment_methods array<string>, faqs array<struct<question:string,answer:string,category:string>>"


def test_analysis_and_reuse(spark):
    brands = spark.createDataFrame([("me.com", "home"), ("solo.com", "gaming")], "site string, category string")
    found = [("me.com", 0, i, 0, 0, f"https://c{i}.com", "s", f"C{i}") for i in range(12)]
    candidates = spark.createDataFrame(found, CANDIDATES + ", name string")
    insights = spark.createDataFrame(
        [record("c0.com", 5, ["x", "a"], ["Visa"], ["G", "G"]), record("c1.com", 2, ["a"], ["Visa", "Amex"], []),
         record("c11.com", 100, ["z"], [], [])], RECORD,
    )
    result = analysis.analyze_competitors(brands, candidates, insights)
    me = result.filter("site = 'me.com'").first()
    # Ten of twelve candidates are kept; two of them have a record.
    assert (me.competitors_found, me.competitors_analyzed, me.avg_products_per_store, me.message) == (10, 2, 3, None)
    assert [tuple(v) for v in me.common_social_platforms] == [("a", 2), ("x", 1)]
    assert [tuple(v) for v in me.common_payment_methods] == [("Visa", 2), ("Amex", 1)]
    assert [tuple(v) for v in me.common_faq_categories] == [("G", 2)]
    solo = result.filter("site = 'solo.com'").first()
    assert (solo.competitors_found, solo.competitors_analyzed) == (4, 0) and solo.message
    stored = store.analysis_rows(result.filter("site = 'me.com'"), now())
    both = analysis.analyze_with_reuse(brands, stored, candidates, insights)
    assert rows(both, "site", "analysis_source") == [("me.com", "stored"), ("solo.com", "computed")]


CURRENT = "site string, brand_name string, logo_url string, payment_methods array<string>, created_at timestamp, updated_at timestamp"


@pytest.fixture(scope="module")
def current(spark):
    stamp = F.expr("timestamp '2024-01-01'")
    base = spark.createDataFrame([("a.com", "A", "l", ["Visa"]), ("b.com", "B", None, None)],
                                 "site string, brand_name string, logo_url string, payment_methods array<string>")
    return base.withColumn("created_at", stamp).withColumn("updated_at", stamp)


def test_upsert_rules(spark, current):
    batch = spark.createDataFrame(
        [("a.com", None, [], "2024-02-02"), ("a.com", "old", ["x"], "2024-02-01"), ("c.com", "C", ["Amex"], "2024-02-01")],
        "site string, brand_name string, payment_methods array<string>, updated_at string",
    )
    once = store.upsert_insights(current, batch, now())
    got = {r.site: r for r in once.collect()}
    a, b, c = got["a.com"], got["b.com"], got["c.com"]
    assert (a.brand_name, a.logo_url, a.payment_methods) == (None, "l", None)
    assert (a.created_at.month, a.updated_at.month) == (1, 3)
    assert (b.brand_name, b.updated_at.month) == ("B", 1)
    assert (c.brand_name, c.logo_url, c.payment_methods, c.created_at.month) == ("C", None, ["Amex"], 3)
    again = store.upsert_insights(once, batch, now())
    key = lambda r: (r.site, r.brand_name, r.logo_url, r.payment_methods, r.created_at, r.updated_at)
    assert sorted(map(key, again.collect()), key=str) == sorted(map(key, once.collect()), key=str)


def test_store_table(spark, current, tmp_path):
    table = store.StoreTable(spark, str(tmp_path / "stores"))
    assert table.read() is None and table.delete(current) is None
    assert table.upsert(current.drop("created_at", "updated_at"), now()) == 1
    found = store.lookup_insights(table.read(), "https://B.com/x").first()
    assert (found.brand_name, found.payment_methods) == ("B", [])
    assert rows(store.list_stores(table.read()), "site", "brand_name") == [("a.com", "A"), ("b.com", "B")]
    removed = table.delete(spark.createDataFrame([("b.com",), ("x.com",)], "site string"))
    assert rows(removed) == [("b.com",)] and rows(table.read(), "site") == [("a.com",)]
    assert table.versions() == [1, 2]
    lookup = plan(store.lookup_insights(table.read(), "a.com"))
    assert "PushedFilters" in lookup and "EqualTo(site,a.com)" in lookup


def test_latest_analysis(spark):
    one = spark.createDataFrame([("a.com", 1)], "site string, competitors_found bigint")
    both = store.analysis_rows(one, now()).unionByName(
        store.analysis_rows(one.withColumn("competitors_found", F.lit(2).cast("bigint")), F.expr("timestamp '2024-04-01'"))
    )
    assert rows(store.lookup_analysis(both, "A.com"), "competitors_found", "original_url") == [(2, "")]


def page(brand, link=""):
    return f"<html><head><title>{brand} - Shop</title></head><body>{link}<div class='product-card'><h3>{brand} lamp</h3></div></body></html>"


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    first = [("https://a.com/", page("Old"), 1), ("https://a.com/", page("Alpha"), 2), ("https://b.com/x", page("Beta"), 1)]
    second = [("https://b.com/", page("Bravo", "<a href='https://x.com/b'>t</a>"), 3), ("https://a.com/deep/er", page("Not main"), 3)]

    def deliver(rows_):
        frame = spark.createDataFrame(rows_, "url string, html string, day int")
        stamped = frame.select("url", "html", F.timestamp_seconds(F.col("day") * 86400).alias("fetched_at"))
        stamped.coalesce(1).write.mode("append").parquet(source)
        return stamped

    def run():
        stream = refresh.page_stream(spark, source, max_files=1)
        refresh.stream_insights(stream, target, checkpoint, compact_every=1).awaitTermination()
        return store.StoreTable(spark, f"{target}/insights")

    one = deliver(first)
    assert rows(run().read(), "site", "brand_name") == [("a.com", "Alpha"), ("b.com", "Beta")]
    two = deliver(second)
    table = run()
    streamed = rows(table.read(), "site", "website_url", "brand_name", F.map_keys("social_handles")[0], "total_products")
    pages_ = refresh.first_per_key(one.unionByName(two), ["url"], [F.col("fetched_at").desc()])
    batch, _ = assemble.build_insights(pages_, staged=False)
    assert streamed == rows(batch, "site", "website_url", "brand_name", F.map_keys("social_handles")[0], "total_products")
    assert [s[2] for s in streamed] == ["Alpha", "Bravo"]
    versions = table.versions()
    assert run().versions() == versions
    # Repeating the last batch gives the same rows.
    refresh.refresh_batch(spark, two, versions[-1] - 1, target)
    assert rows(table.read(), "site", "brand_name") == [("a.com", "Alpha"), ("b.com", "Bravo")]


def test_registry_lists_the_operators():
    assert {"links", "products_from_feed", "hero_products", "policy_embedded", "faq_blocks", "upsert_insights",
            "competitor_summary", "assemble_insights", "stream_insights"} <= set(OPERATORS)


def test_a_repeated_analysis_returns_the_rows_of_its_first_run(spark, tmp_path):
    brands = spark.createDataFrame([("me.com", "home"), ("old.com", "home")], "site string, category string")
    candidates = spark.createDataFrame([("me.com", 0, 0, 0, 0, "https://c0.com", "s", "C0")], CANDIDATES + ", name string")
    insights = spark.createDataFrame([record("c0.com", 5, ["x"], ["Visa"], [])], RECORD)
    stored = store.analysis_rows(spark.createDataFrame([("old.com", 7)], "site string, competitors_found bigint"), now())
    log = store.AnalysisLog(spark, str(tmp_path / "log"))
    one = rows(analysis.analyze_with_reuse(brands, stored, candidates, insights, log=log), "site", "competitors_found", "reused")
    assert one == [("me.com", 1, False), ("old.com", 7, True)]
    kept = rows(log.read())
    # Other inputs change nothing for the same missing brands; a further brand is another run.
    assert rows(analysis.analyze_with_reuse(brands, stored, candidates.limit(0), insights, log=log), "site", "competitors_found", "reused") == one
    assert rows(log.read()) == kept
    more = brands.unionByName(spark.createDataFrame([("new.com", "home")], "site string, category string"))
    assert analysis.analyze_with_reuse(more, stored.unionByName(log.read(), allowMissingColumns=True), candidates, insights, log=log).filter("not reused").count() == 1
    assert {r.site for r in log.read().collect()} == {"me.com", "new.com"}


def test_filters_on_rendered_pages_stay_behind_the_deal(spark, tmp_path):
    spark.range(9).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'x y' as p_name", "1.5D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rendered = inputs.parts(spark, str(tmp_path)).select(F.concat(F.lit("<p>"), "handle").alias("html")).filter("html rlike 'p>x-y-[0-8]$'")
    plan = rendered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("RepartitionByExpression") and rendered.count() == 9


def test_a_candidate_s_host_is_taken_once(spark):
    rows = [("a.com", "https://www.Shop.com/x"), ("a.com", "https://A.com/"), ("a.com", "https://m.facebook.com/a"), ("a.com", "ftp://b.com/"), ("a.com", None)]
    found = competitors.valid_candidates(spark.createDataFrame(rows, "site string, url string"))
    assert [r.url for r in found.collect()] == [rows[0][1]]
    condition = found._jdf.queryExecution().optimizedPlan().toString()
    assert condition.count("regexp_extract_all") == 1 and "RLIKE" not in condition
