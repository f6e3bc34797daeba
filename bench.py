"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Every
query is built and run in full into the ``noop`` sink, so that writing and collecting
are not part of the time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rentalytics.plans.catalog import QUERIES  # noqa: E402
from rentalytics.runtime import local_session  # noqa: E402

HEADLINE = (
    "listing_score", "segment_dashboard", "best_deals", "worst_deals", "accessibility_segments",
    "amenity_tiers", "insight_columns", "feature_impact", "geo_hotspots", "strategy_scores",
    "listing_score_star", "geo_hotspots_star", "fact_listings", "keyed_listings",
    "dim_location", "check_star",
    "union_sources", "null_profile", "impute_amenities", "impute_distances", "impute_rooms",
    "anova_price_p", "manova_wilks_p", "tukey_hsd", "numeric_summary", "box_stats",
    "iqr_filter", "apply_filters", "kpis", "value_share", "map_sample",
    "listing_urls_pages", "page_text", "extract_listings", "ingest_city_files",
    "evaluate_price_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
