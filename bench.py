"""Time the headline queries on whole tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pressroom.plans.queries import QUERIES
from pressroom.session import build_session

HEADLINE = ("training_rows", "training_stats", "balance_neutral", "oversample", "route_events", "clean_pages",
            "extractive_summary", "keyword_tags", "parse_tags", "ngrams", "reuse_processed", "merge_backend",
            "merge_user", "late_enrichment", "article_archive", "topk_categories", "ordered_tag_features", "tfidf_vocab")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"), "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false"})
    names = sys.argv[1:] or HEADLINE
    QUERIES["training_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM and code caches
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
