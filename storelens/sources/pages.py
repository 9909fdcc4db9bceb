"""Page snapshots as a DataFrame ``pages(url, html[, fetched_at])``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions import urls
from storelens.operators.ranking import first_per_key
from storelens.operators.registry import operator
from storelens.session import stage

PAGE_SCHEMA = "url string, html string, fetched_at timestamp"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from Parquet, ORC or JSON lines, or one HTML file per page (``fmt='text'``: the file path is the URL)."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    reader = spark.read.schema(PAGE_SCHEMA) if fmt == "json" else spark.read
    pages = reader.format(fmt).load(path)
    kept = [c for c in ("url", "html", "fetched_at", "headers") if c in pages.columns]
    return pages.select(*kept).filter("html is not null and html <> ''")


def current_pages(pages: DataFrame) -> DataFrame:
    """One snapshot of every URL: the newest, a missing time being the oldest; of equal times that with the greatest MD5.

    First only URLs are counted. Those with several rows get their winning (time, MD5) from an aggregation that
    leaves page text behind, and the rows that have it stay. Texts are only grouped where the very same snapshot is
    there more than once.
    """
    stamp = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    several = stage(pages.groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url"), "several")
    if several.isEmpty():
        return pages
    seen = pages.select("url", stamp.alias("time"), F.md5("html").alias("content")).join(several, "url", "left_semi")
    seen = seen.groupBy("url", "time", "content").agg(F.count("*").alias("copies"))
    best = seen.groupBy("url").agg(F.max(F.struct("time", "content", "copies")).alias("best"))
    best = stage(best.select("url", "best", F.lit(True).alias("repeated")), "newest")
    held = pages.join(best, "url", "left")
    wins = stamp.eqNullSafe(F.col("best.time")) & F.md5("html").eqNullSafe(F.col("best.content"))
    kept = held.filter(F.col("repeated").isNull() | wins)
    copied = F.coalesce(F.col("best.copies") > 1, F.lit(False))
    if best.filter(copied).isEmpty():
        return kept.select(*pages.columns)
    rest = [c for c in pages.columns if c != "url"]
    one = kept.filter(copied).groupBy("url").agg(F.any_value(F.struct(*rest)).alias("row")).select("url", *[f"row.{c}" for c in rest])
    return kept.filter(~copied).select(*pages.columns).unionByName(one)


#: URLs of main pages that don't show it by themselves are broadcast up to so many (some 20 MB).
BROADCAST_URLS = 200_000


def needed_pages(pages: DataFrame, paths=(), marks=()) -> DataFrame:
    """Pages of which any rule reads the text: per site the first by (depth, URL), home pages, those on a path of ``paths``,
    and those whose URL holds one of ``marks``.

    URLs decide alone: ``site`` and ``page_rank`` come from them, and no text is read to choose. Where a site's first page is not
    a home page its URL is joined. Where the first page has no text, all pages of that site are kept, so that another can stand for it.
    """
    base = pages.filter(urls.valid_url(F.col("url"))).withColumn("site", urls.host_of(F.col("url"))).withColumn("page_rank", urls.page_rank(F.col("url")))
    path = urls.path_of(F.col("url"))
    by_url = (F.col("page_rank") == 0) | (path.isin(*paths) if paths else F.lit(False))
    for mark in marks:
        by_url = by_url | F.col("url").contains(mark)
    first = base.groupBy("site").agg(F.min(F.struct("page_rank", "url")).alias("first"))
    first = stage(first.select("site", "first.url", "first.page_rank"), "first_pages")
    lonely = first.filter(~by_url).select("url", F.lit(True).alias("is_first"))
    with_text = F.col("html") != ""
    if lonely.count() <= BROADCAST_URLS:
        chosen = base.join(F.broadcast(lonely), "url", "left").filter((by_url | F.col("is_first").isNotNull()) & with_text).drop("is_first")
    else:
        chosen = base.filter(by_url & with_text).unionByName(base.filter(~by_url & with_text).join(lonely, "url", "left_semi"))
    blank = base.join(first.select("url"), "url", "left_semi").filter(F.coalesce(~with_text, F.lit(True))).select("site").distinct()
    blank = stage(blank, "sites_without_first")
    if blank.isEmpty():
        return chosen
    # Their pages by URL are chosen already.
    others = base.filter(~by_url & with_text).join(blank, "site", "left_semi").join(lonely, "url", "left_anti")
    return chosen.unionByName(others.select(*chosen.columns))


@operator("latest_pages")
def latest_pages(pages: DataFrame) -> DataFrame:
    """The newest snapshot per URL: one shuffle by URL, after each task has kept its own newest ones."""
    return first_per_key(pages, ["url"], [F.col("fetched_at").desc(), F.xxhash64("html")])
