"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "link_filter",
    "html_extract",
    "dedup_new",
    "tfidf_weights",
    "similarity_threshold",
    "centrality",
    "similar_articles",
    "centroid_tags",
    "daily_analysis",
    "home_feed",
    "bm25_search",
    "search_strict",
    "vector_topk",
    "stream_day_counts",
)


def main() -> None:
    from newsloom.catalog import REGISTRY
    from newsloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores, **{"spark.ui.showConsoleProgress": "false"})
    # start the JVM code paths and the Python workers before the clock runs
    REGISTRY["tfidf_similarity"](spark, sf_dir.replace(os.path.basename(sf_dir), "sf0.001")).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 2)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
