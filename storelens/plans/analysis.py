"""Competitor analysis of every brand in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.operators import competitors, relations
from storelens.operators.ranking import candidate_quota
from storelens.operators.registry import operator
from storelens.session import stage
from storelens.sources.feeds import read_search_links
from storelens.sources.store import AnalysisLog, analysis_rows, lookup_analysis

#: Search strategies in the order in which their candidates count.
WEB, SIMILAR, INDUSTRY = 0, 1, 2


@operator("analyze_competitors")
def analyze_competitors(
    brands: DataFrame,
    candidates: DataFrame,
    insights: DataFrame,
    *,
    directory=rules.STORE_DIRECTORY,
    max_competitors: int = rules.COMPETITOR_LIMIT,
    staged: bool = True,
    with_records: bool = False,
) -> DataFrame:
    """One analysis row per brand ``(site, category[, brand_name, website_url])``.

    ``candidates`` are verified candidates; brands without any use the directory.  ``insights`` are the
    store records of all sites; competitors without a record count as found, not as analysed.
    ``with_records`` adds ``competitor_insights``: the analysed competitors, each with its store record as JSON.
    """
    found = competitors.find_competitors(brands, candidates, n=max_competitors, directory=directory)
    if staged:  # at most max_competitors rows per brand
        found = stage(found, "competitors")
    analyzed = competitors.competitor_insights(found, competitors.insight_stats(insights))
    summary = competitors.competitor_summary(analyzed, brands)
    if with_records:
        summary = summary.join(competitors.competitor_records(found, insights), "site", "left").withColumn(
            "competitor_insights", F.coalesce("competitor_insights", F.array().cast(competitors.RECORDS))
        )
    given = {"original_brand": "brand_name", "original_url": "website_url"}
    named = [(F.col(c) if c in brands.columns else F.lit("")).alias(name) for name, c in given.items()]
    return summary.join(brands.select("site", *named), "site")


@operator("candidates_from_search")
def candidates_from_search(
    results: DataFrame, store_pages: DataFrame, *, quota: int = rules.CANDIDATE_QUOTA, engines=rules.SEARCH_ENGINE_RULES,
    staged: bool = True,
) -> DataFrame:
    """Verified candidates of every brand from saved result pages and saved pages of stores.

    ``results(site, strategy, query_rank, engine, url, html)`` are the result pages of a brand's queries, ``store_pages(url,
    html[, headers])`` the pages of any stores. A candidate counts if a page of its host is on the platform; a query has the candidates
    of its first engine with one. Only the web strategy ends once it has ``quota`` of them, after the query that
    reaches it.

    Pages of stores are read where they lie: only (host, flag) of those on the platform are shuffled. What is
    verified is short and written once, as the quota reads it twice.
    """
    links = read_search_links(results, engines)
    flags = relations.detect_platform_loose(store_pages).select("site", "on_platform")
    if staged:  # one short row per host: once its size is known, links need no shuffle to meet few hosts
        flags = stage(flags.filter("on_platform").distinct(), "on_platform")
    found = competitors.verify_candidates(links, flags)
    if staged:
        found = stage(found, "verified")
    web, similar, industry = (found.filter(F.col("strategy") == s).drop("strategy") for s in (WEB, SIMILAR, INDUSTRY))
    return competitors.union_candidates(candidate_quota(web, quota), similar, industry)


@operator("competitors_from_search")
def competitors_from_search(
    brand_pages: DataFrame, brands: DataFrame, results: DataFrame, store_pages: DataFrame, insights: DataFrame,
    *, quota: int = rules.CANDIDATE_QUOTA, engines=rules.SEARCH_ENGINE_RULES, **options,
) -> DataFrame:
    """The whole competitor job: brands' own pages, saved result pages and store pages to one analysis row per brand.

    ``brands(site[, brand_name, website_url])`` get their category from their main page in ``brand_pages``, the default
    where there is none; ``options`` are those of ``analyze_competitors``.
    """
    named = competitors.competitor_category(brand_pages)
    category = named.groupBy("site").agg(F.min_by("category", F.struct("page_rank", "url")).alias("category"))
    known = brands.join(category, "site", "left").withColumn("category", F.coalesce("category", F.lit(rules.BRAND_DEFAULT_CATEGORY)))
    staged = options.get("staged", True)
    if staged:  # one short row per brand, which the plan reads several times
        known = stage(known, "brands")
    candidates = candidates_from_search(results, store_pages, quota=quota, engines=engines, staged=staged)
    return analyze_competitors(known, candidates, insights, **options)


def analyze_with_reuse(
    brands: DataFrame, stored: DataFrame, candidates: DataFrame, insights: DataFrame, *, log: AnalysisLog | None = None,
    run: str | None = None, now: Column | None = None, **options,
) -> DataFrame:
    """Stored analyses where a brand has one, fresh ones otherwise.

    With a ``log``, fresh ones are appended to it as ``run`` and read from there. Without a name for it the run is
    named by the brands that lack an analysis, so a job that is repeated finds its rows and returns them as they are.
    """

    def fresh(missing: DataFrame) -> DataFrame:
        def computed():
            return analyze_competitors(missing, candidates, insights, **options)

        if log is None:
            return computed()
        name = run or "{}-{:x}-{:x}".format(*missing.agg(
            F.count("*"), *[F.coalesce(F.sum(F.pmod(F.xxhash64("site", F.lit(seed)), F.lit(1 << 31))), F.lit(0)) for seed in (1, 2)]
        ).first())
        return log.append_once(name, lambda: analysis_rows(computed(), now))

    latest = lookup_analysis(stored)
    fresh_columns = [c for c in latest.columns if c not in ("analysis_id", "created_at", "updated_at")]
    return competitors.reuse_or_compute(
        brands,
        latest.select(*fresh_columns),
        lambda missing: fresh(missing).select(*fresh_columns),
    ).withColumn("analysis_source", F.when(F.col("reused"), "stored").otherwise("computed"))
