"""Competitor stores: category, candidates, checks, fallback and the summary per brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import text, urls
from storelens.operators import relations
from storelens.operators.ranking import first_per_key, limit_per_key
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

ORDER = ("strategy", "query_rank", "engine_rank", "seq", "url")
RECORDS = "array<struct<competitor_name:string,competitor_url:string,insights:string>>"


@operator("competitor_category")
def competitor_category(
    pages: DataFrame, category_rules=rules.BRAND_CATEGORY_RULES, *, word_boundary: bool = False
) -> DataFrame:
    """Brand category of a page by its description, title and first paragraphs."""
    category = text.brand_category(F.col("lead"), category_rules, word_boundary=word_boundary)
    return relations.lead_text(pages).select(*PAGE, category.alias("category"))


@operator("valid_candidate")
def valid_candidates(candidates: DataFrame, excluded=rules.EXCLUDED_HOSTS) -> DataFrame:
    """Candidates ``(site, url)`` on another, not excluded host."""
    hosted = candidates.withColumn("_host", urls.host_of(F.col("url")))
    return hosted.filter(urls.other_store(F.col("_host"), F.col("url"), F.col("site"), excluded)).drop("_host")


@operator("verify_candidates")
def verify_candidates(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """Valid candidates whose stored page is on the platform, named from their URL.

    ``flags(site, on_platform)`` holds the page flags; only the first engine with a hit counts per query.
    """
    on_platform = flags.filter("on_platform").select(F.col("site").alias("candidate_site")).distinct()
    checked = valid_candidates(candidates).withColumn("candidate_site", urls.host_of(F.col("url")))
    verified = checked.join(on_platform, "candidate_site", "left_semi")
    query = Window.partitionBy("site", "strategy", "query_rank")
    return (
        verified.withColumn("_first", F.min("engine_rank").over(query))
        .filter("engine_rank = _first")
        .drop("_first", "candidate_site")
        .withColumn("name", urls.name_from_url(F.col("url")))
    )


@operator("dedup_candidates")
def dedup_candidates(candidates: DataFrame, order=ORDER) -> DataFrame:
    """Valid candidates, first per site and name.

    Names come from the lowercase host, so equal URLs always have equal names and the first
    per name is also the first per URL.
    """
    order = [c for c in order if c in candidates.columns]
    return first_per_key(valid_candidates(candidates), ["site", F.lower("name")], order)


@operator("dedup_candidates_by_host")
def dedup_candidates_by_host(candidates: DataFrame, order=ORDER) -> DataFrame:
    order = [c for c in order if c in candidates.columns]
    return first_per_key(candidates, ["site", urls.host_of(F.col("url"))], order)


@operator("union_candidates")
def union_candidates(web: DataFrame, similar: DataFrame, industry: DataFrame) -> DataFrame:
    """Candidates of the three search strategies in that order."""
    parts = [df.withColumn("strategy", F.lit(i)) for i, df in enumerate((web, similar, industry))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def directory_candidates(brands: DataFrame, directory=rules.STORE_DIRECTORY) -> DataFrame:
    """Known stores of every brand's category.

    The directory is a literal table of the program, so its broadcast has a fixed size.
    """
    rows = [(category, i, name, url) for i, (category, name, url) in enumerate(directory)]
    stores = brands.sparkSession.createDataFrame(rows, "listed string, seq int, name string, url string")
    known = sorted({category for category, _, _ in directory})
    listed = F.when(F.col("category").isin(known), F.col("category")).otherwise(rules.DIRECTORY_DEFAULT)
    matched = brands.withColumn("listed", listed).join(F.broadcast(stores), "listed")
    return valid_candidates(matched).select("site", "seq", "name", "url", F.lit("fallback").alias("source"))


@operator("fallback_candidates")
def fallback_candidates(brands: DataFrame, found: DataFrame, directory=rules.STORE_DIRECTORY) -> DataFrame:
    """Known stores of a brand's category, for brands ``(site, category)`` without any candidate."""
    lonely = brands.join(found.select("site").distinct(), "site", "left_anti")
    return directory_candidates(lonely, directory)


@operator("find_competitors")
def find_competitors(
    brands: DataFrame, candidates: DataFrame, *, n: int = rules.COMPETITOR_LIMIT, directory=rules.STORE_DIRECTORY
) -> DataFrame:
    """At most ``n`` competitors per brand: its own candidates, else the directory.

    Every brand gets its few directory rows, which are dropped where it has own candidates: that reads
    the candidates once, where an anti join would read them twice.
    """
    columns = ("site", "name", "url", "source", "rank")
    order = [c for c in ORDER if c in candidates.columns]
    unique = dedup_candidates(candidates.join(brands.select("site"), "site", "left_semi"))
    own = limit_per_key(unique, ["site"], order, n, rank="rank").select(*columns, F.lit(0).alias("choice"))
    listed = directory_candidates(brands, directory).withColumnRenamed("seq", "rank")
    both = own.unionByName(listed.select(*columns, F.lit(1).alias("choice")))
    site = Window.partitionBy("site")
    chosen = both.withColumn("best", F.min("choice").over(site)).filter("choice = best")
    return limit_per_key(chosen, ["site"], ["rank"], n, rank="place").select(
        "site", "name", "url", "source", F.col("place").alias("rank")
    )


def insight_stats(insights: DataFrame) -> DataFrame:
    """What the summary needs of a store record: a few short columns."""
    return insights.select(
        F.col("site").alias("competitor_site"),
        F.coalesce("total_products", F.lit(0)).cast("bigint").alias("products"),
        F.coalesce(F.map_keys("social_handles"), F.array().cast("array<string>")).alias("social"),
        F.coalesce("payment_methods", F.array().cast("array<string>")).alias("payments"),
        F.coalesce(F.transform("faqs", lambda f: f["category"]), F.array().cast("array<string>")).alias("faq"),
    )


@operator("competitor_insights")
def competitor_insights(competitors: DataFrame, stats: DataFrame) -> DataFrame:
    """Competitors with the stats of their own store; ``analyzed`` is false where there is none.

    A few stores are competitors of very many brands: the join is a plain one between two shuffles, whose
    large partitions adaptive execution splits (``spark.sql.adaptive.skewJoin.enabled``).
    """
    keyed = competitors.withColumn("competitor_site", urls.host_of(F.col("url")))
    joined = keyed.join(stats, "competitor_site", "left")
    return joined.withColumn("analyzed", F.col("products").isNotNull())


@operator("competitor_records")
def competitor_records(found: DataFrame, insights: DataFrame) -> DataFrame:
    """Per brand its competitors that have a store record, by rank, with the record as JSON text: (site, competitor_insights).

    A brand has the few competitors that ``find_competitors`` left it, so its list is short. A store that very many brands
    compete with is a hot key of the join, whose partitions adaptive execution splits.
    """
    records = insights.select(F.col("site").alias("competitor_site"), F.to_json(F.struct(*insights.columns)).alias("insights"))
    held = found.withColumn("competitor_site", urls.host_of(F.col("url"))).join(records, "competitor_site")
    entry = F.struct("rank", F.col("name").alias("competitor_name"), F.col("url").alias("competitor_url"), "insights")
    ranked = F.array_sort(F.collect_list(entry))
    return held.groupBy("site").agg(F.transform(ranked, lambda e: e.dropFields("rank")).alias("competitor_insights"))


@operator("competitor_summary")
def competitor_summary(analyzed: DataFrame, brands: DataFrame, k: int = rules.TOP_VALUES) -> DataFrame:
    """One row per brand: competitors found and analysed, floor average of catalog sizes, most common
    social platforms, payment methods and FAQ categories, and a message where nothing was analysed."""
    kinds = {"social": "common_social_platforms", "payments": "common_payment_methods", "faq": "common_faq_categories"}

    def entries(column, kind):
        return F.transform(column, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    # One entry stands for the competitor itself, so sizes and frequencies come from the same pass.
    itself = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")))
    values = F.flatten(F.array_compact(F.array(itself, *[entries(column, kind) for column, kind in kinds.items()])))
    counts = (
        analyzed.select("site", "products", "analyzed", F.explode(values).alias("v"))
        .groupBy("site", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
        .agg(F.count("*").alias("cnt"), F.sum("products").alias("products"), F.count_if("analyzed").alias("analyzed"))
    )
    top = limit_per_key(counts, ["site", "kind"], [F.col("cnt").desc(), "value"], k, rank="rank")
    entry = F.struct("rank", "value", "cnt")

    def common(kind):
        ranked = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))
        return F.transform(ranked, lambda e: F.struct(e["value"].alias("value"), e["cnt"].alias("cnt"))).alias(kind)

    def size(column):
        return F.any_value(F.when(F.col("kind") == "", F.col(column)), F.lit(True))

    per_site = top.groupBy("site").agg(
        size("cnt").alias("competitors_found"),
        size("analyzed").alias("competitors_analyzed"),
        size("products").alias("products"),
        *[common(n) for n in kinds.values()],
    )
    empty = F.array().cast("array<struct<value:string,cnt:bigint>>")
    analyzed_count = F.coalesce("competitors_analyzed", F.lit(0))
    return (
        brands.select("site")
        .join(per_site, "site", "left")
        .select(
            "site",
            F.coalesce("competitors_found", F.lit(0)).alias("competitors_found"),
            analyzed_count.alias("competitors_analyzed"),
            F.coalesce(F.expr("products div nullif(competitors_analyzed, 0)"), F.lit(0)).alias("avg_products_per_store"),
            *[F.coalesce(n, empty).alias(n) for n in kinds.values()],
            F.when(analyzed_count == 0, F.lit("No competitor insights available")).alias("message"),
        )
    )


@operator("reuse_or_compute")
def reuse_or_compute(brands: DataFrame, stored: DataFrame, compute) -> DataFrame:
    """Stored rows of the brands; ``compute(missing brands)`` for those without one."""
    kept = stored.join(brands.select("site"), "site", "left_semi").withColumn("reused", F.lit(True))
    fresh = compute(brands.join(stored.select("site"), "site", "left_anti")).withColumn("reused", F.lit(False))
    return kept.unionByName(fresh)
