"""Ordered dedup, per-key limits and top-k that stand a hot key.

Every rank here is filtered right after it is taken, so Spark cuts each map
task's rows to the first n per key before the shuffle (WindowGroupLimit): a key
that holds a third of all rows reaches its reducer as n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens import rules
from storelens.operators.registry import operator


def _columns(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


@operator("limit_per_key")
def limit_per_key(df: DataFrame, keys, order, n: int, *, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``; ``rank`` names a column for the position."""
    window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
    out = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


@operator("limit_per_site")
def limit_per_site(df: DataFrame, n: int = rules.CATALOG_LIMIT, *, order=("branch", "page_rank", "url", "seq")):
    return limit_per_key(df, ["site"], order, n)


@operator("first_per_key")
def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first whole row per key."""
    return limit_per_key(df, keys, order, 1)


@operator("first_wins")
def first_wins(df: DataFrame, keys, value: str, order) -> DataFrame:
    """Value of the first row per key; partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*_columns(order))).alias(value))


@operator("last_wins")
def last_wins(df: DataFrame, keys, value: str, order) -> DataFrame:
    """Value of the last row per key; partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*_columns(order))).alias(value))


@operator("collect_distinct")
def collect_distinct(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct non-null values per key in long form: one row per (key, value)."""
    return df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()


@operator("top_k_values")
def top_k_values(df: DataFrame, keys, value: str, k: int = rules.TOP_VALUES) -> DataFrame:
    """The k most frequent values per key; ties go to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    return limit_per_key(counts, keys, [F.col("cnt").desc(), F.col(value)], k, rank="rank")


@operator("dedup_products")
def dedup_products(products: DataFrame, style: str = "default", *, order=("branch", "page_rank", "url", "seq")):
    """Keep the first product per site and key, in page order.

    Keys: ``default`` lower(name) and URL, ``exact`` name and URL, ``legacy`` name.
    """
    link = F.coalesce("product_url", F.lit(""))
    keys = {
        "default": [F.lower("name"), link],
        "exact": [F.col("name"), F.coalesce("product_url", F.lit(""))],
        "legacy": [F.col("name")],
    }[style]
    named = products.filter(F.coalesce("name", F.lit("")) != "")
    return first_per_key(named, ["site", *keys], order)


@operator("dedup_products_exact")
def dedup_products_exact(products: DataFrame, **options) -> DataFrame:
    return dedup_products(products, "exact", **options)


@operator("dedup_products_legacy")
def dedup_products_legacy(products: DataFrame, **options) -> DataFrame:
    return dedup_products(products, "legacy", **options)


@operator("candidate_quota")
def candidate_quota(candidates: DataFrame, quota: int = rules.CANDIDATE_QUOTA) -> DataFrame:
    """Keep a site's queries in rank order until the running total before a query reaches the quota.

    Each strategy of a site has a quota of its own where the candidates say theirs. Only the per-query
    counts are windowed, so the window holds one row per query; the rows themselves are kept by a join.
    """
    own = ["site", *[c for c in ("strategy",) if c in candidates.columns]]
    counts = candidates.groupBy(*own, "query_rank").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*own).orderBy("query_rank").rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("found_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(
        F.col("found_before") < quota
    )
    return candidates.join(kept.select(*own, "query_rank"), [*own, "query_rank"], "left_semi")
