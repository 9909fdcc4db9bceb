"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storelens import suite  # noqa: E402
from storelens.session import local_session  # noqa: E402

HEADLINE = (
    "links", "page_text", "important_links", "slots_per_category", "social_links", "brand_record", "contacts",
    "payment_methods", "policy_links", "union_policies", "policy_page_detail", "faq_page_set", "read_faq_feed",
    "products_from_feed", "products_from_jsonld", "products_from_cards", "union_products", "hero_products",
    "hero_position", "dedup_products", "top_k_values", "verify_candidates", "competitor_summary", "upsert_insights",
    "main_page_names", "assemble_insights", "assemble_catalog",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    suite.load()
    spark = local_session(cpus, "bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("sum(length(html))").collect()  # start the JVM and workers
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
