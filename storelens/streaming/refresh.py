"""Incremental refresh of the store from arriving pages, product feeds, sitemaps and page feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storelens.functions import urls
from storelens.operators.ranking import first_per_key
from storelens.operators.registry import operator
from storelens.plans import assemble
from storelens.sources.pages import PAGE_SCHEMA
from storelens.sources.store import StoreTable, Versions, by_bucket, complete_folders

BUCKETS = 256

#: What a delivery can be. Pages are kept as digests, the other kinds as they came.
PAGES, FEEDS, SITEMAPS, FAQ_FEEDS = KINDS = ("page", "feed", "sitemap", "faq_feed")
DELIVERY_SCHEMA = "kind string, url string, body string, fetched_at timestamp"


def page_stream(spark: SparkSession, path: str, fmt: str = "parquet", *, schema: str = PAGE_SCHEMA, max_files=None):
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def tagged(**sources: DataFrame | None) -> DataFrame:
    """Streams or tables of several kinds as one of deliveries ``(kind, url, body, fetched_at)``.

    Names are those of ``KINDS``. Pages have their text in ``html``, the others in ``body``; a source without
    ``fetched_at`` has no times, which makes its rows older than any with one.
    """
    unknown = set(sources) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of deliveries: {sorted(unknown)}")
    parts = []
    for kind, rows in sources.items():
        if rows is not None:
            stamp = F.col("fetched_at") if "fetched_at" in rows.columns else F.lit(None)
            text = F.col("html" if kind == PAGES else "body")
            parts.append(rows.select(F.lit(kind).alias("kind"), "url", text.alias("body"), stamp.cast("timestamp").alias("fetched_at")))
    if not parts:
        raise ValueError("no source of deliveries")
    return reduce(lambda a, b: a.unionByName(b), parts)


@operator("stream_page_dedup")
def stream_page_dedup(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop pages delivered again (same URL and content) within the watermark delay."""
    return (
        pages.withColumn("content_hash", F.xxhash64("html"))
        .withWatermark("fetched_at", delay)
        .dropDuplicatesWithinWatermark(["url", "content_hash"])
    )


class History:
    """Rows of all batches by key, as folders ``batch=N`` in site buckets; the newest row per key counts.

    A repeated batch replaces exactly what it wrote. Merged folders keep the number of files small.
    """

    def __init__(self, spark: SparkSession, store_path: str, name: str, keys: tuple, schema: T.StructType):
        self.spark, self.root, self.keys = spark, f"{store_path}/{name}", keys
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType())])
        self.merged = Versions(spark, f"{store_path}/{name}_compacted")

    def add(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's rows, which have a ``site``, and return them as written."""
        held = rows.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(BUCKETS)).cast("int"))
        by_bucket(held).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch_id}")
        return self._read(batch_id)

    def _read(self, *batches: int) -> DataFrame:
        read = self.spark.read.schema(self.schema).option("basePath", self.root)
        return read.parquet(*[f"{self.root}/batch={b}" for b in batches])

    def known(self, batch_id: int) -> DataFrame:
        """Rows up to a batch, which has been added: the last merged table and the batch folders after it."""
        base = max((v for v in self.merged.versions() if v <= batch_id), default=-1)
        batches = [b for b in complete_folders(self.spark, self.root, "batch") if base < b <= batch_id]
        parts = [self._read(*batches)] if batches else []
        if base >= 0:
            merged = self.spark.read.schema(self.schema).parquet(self.merged.folder(base))
            parts.append(merged.withColumn("batch", F.lit(base)))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def newest(self, rows: DataFrame) -> DataFrame:
        return first_per_key(rows, self.keys, [F.col("fetched_at").desc_nulls_last(), F.col("batch").desc()])

    def compact(self, batch_id: int) -> None:
        rows = self.newest(self.known(batch_id)).drop("batch")
        self.merged.write(by_bucket(rows), batch_id, partition_by=("bucket",))


def digests(spark: SparkSession, store_path: str, schema: T.StructType) -> History:
    return History(spark, store_path, "digests", ("url",), schema)


def deliveries(spark: SparkSession, store_path: str) -> History:
    schema = spark.createDataFrame([], f"{DELIVERY_SCHEMA}, site string").schema
    return History(spark, store_path, "deliveries", ("kind", "url"), schema)


@operator("compact_digests")
def compact_digests(spark: SparkSession, store_path: str, batch_id: int) -> None:
    """Merge the batch folders into one table with the newest row per URL, so that their number stays small."""
    schema = assemble.page_digest(spark.createDataFrame([], PAGE_SCHEMA)).schema
    for history in (digests(spark, store_path, schema), deliveries(spark, store_path)):
        if batch_id in complete_folders(spark, history.root, "batch"):
            history.compact(batch_id)


def _latest(rows: DataFrame, keys: list, text: str) -> DataFrame:
    return first_per_key(rows, keys, [F.col("fetched_at").desc_nulls_last(), F.xxhash64(text)])


def _of_kind(rows: DataFrame, *kinds: str) -> Column:
    return F.coalesce(F.col("kind").isin(*kinds), F.lit(False))


def refresh_batch(
    spark: SparkSession, pages: DataFrame, batch_id: int, store_path: str, *, compact_every: int = 100,
    params: assemble.Params = assemble.Params(),
) -> None:
    """Apply one batch of pages, or of deliveries (``tagged``) when there is a ``kind``.

    The batch's page digests and other deliveries go to folders of their own, spread over site buckets, so a retried batch
    replaces exactly what it wrote. Every site that anything of the batch belongs to is then rebuilt from its newest
    digests and deliveries - read from the touched buckets only. Its catalog rows are replaced in ``catalog`` and its record is
    upserted in ``insights``, both under the batch's version number, the catalog first.

    The newest body of a feed page, sitemap or page feed counts, an empty one too: that takes its products, URLs or questions
    away. Rows of an unknown kind or without a valid URL are ignored. A site that only has feeds has catalog rows, but no record.
    """
    every_kind = "kind" in pages.columns
    own = pages.filter(_of_kind(pages, PAGES)).withColumnRenamed("body", "html") if every_kind else pages
    new = assemble.page_digest(_latest(own, ["url"], "html"), params)
    page_rows = digests(spark, store_path, new.schema)
    sites = page_rows.add(new, batch_id).select("site", "bucket")
    if every_kind:
        url = F.col("url")
        others = pages.filter(_of_kind(pages, FEEDS, SITEMAPS, FAQ_FEEDS) & urls.valid_url(url)).withColumn("site", urls.host_of(url))
        sent_rows = deliveries(spark, store_path)
        sent = sent_rows.add(_latest(others.select("kind", "site", "url", "body", "fetched_at"), ["kind", "url"], "body"), batch_id)
        sites = sites.unionByName(sent.select("site", "bucket"))
    touched = [r.bucket for r in sites.select("bucket").distinct().collect()]  # at most BUCKETS values
    if not touched:
        return

    def kept(rows: DataFrame, name: str) -> DataFrame:
        """Rows written once, as the rules read them several times; the next batch overwrites them."""
        path = f"{store_path}/work/{name}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    sites = kept(sites.select("site").distinct(), "sites")

    def current(history: History) -> DataFrame:
        known = history.known(batch_id).filter(F.col("bucket").isin(touched))
        return history.newest(known.join(sites, "site", "left_semi")).drop("bucket", "batch")

    digest = kept(current(page_rows), "digest")
    main = kept(assemble.main_pages(digest), "main")
    feeds = sitemaps = faq_feeds = None
    if every_kind:
        sent = kept(current(sent_rows), "deliveries")
        feeds, sitemaps, faq_feeds = (sent.filter(F.col("kind") == k).select("url", "body") for k in (FEEDS, SITEMAPS, FAQ_FEEDS))
    catalog = kept(assemble.build_catalog(digest, main, feeds, sitemaps, params), "catalog")
    insights = assemble.insights_from_digest(digest, main, catalog, feeds=feeds, faq_feeds=faq_feeds, params=params)
    StoreTable(spark, f"{store_path}/catalog").replace(catalog, sites, version=batch_id + 1)
    StoreTable(spark, f"{store_path}/insights").upsert(kept(insights, "insights"), version=batch_id + 1)
    if batch_id % compact_every == compact_every - 1:
        page_rows.compact(batch_id)
        if every_kind:
            sent_rows.compact(batch_id)


@operator("stream_insights")
def stream_insights(
    pages: DataFrame, store_path: str, checkpoint: str, *, compact_every: int = 100,
    params: assemble.Params = assemble.Params(), **trigger
) -> StreamingQuery:
    """Keep the records and the catalog under ``store_path`` up to date with a stream of pages or of deliveries (``tagged``).

    A restart from the checkpoint repeats at most the last batch, which rewrites its own version.
    """
    trigger = trigger or {"availableNow": True}
    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(
            lambda df, batch_id: refresh_batch(
                df.sparkSession, df, batch_id, store_path, compact_every=compact_every, params=params
            )
        )
        .start()
    )
